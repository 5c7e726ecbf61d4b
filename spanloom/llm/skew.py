"""Joins whose left keys may repeat without bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: A key of more rows than MOST, and than the rows / HOT_KEYS, is hot: so there are fewer than HOT_KEYS, which bounds their broadcast list.
MOST, HOT_KEYS = 1000, 100_000


def salted_join(left: DataFrame, right: DataFrame, key: str, salt: list[str], counts: DataFrame, most: int = MOST) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right``; no task gets more than ``most`` rows of a hot key.

    ``counts`` (key, n) has the rows of ``left`` for each key, or for all that ``right`` has too.  Rows of a hot key
    are dealt by the hash of the ``salt`` columns, and its row of ``right`` is copied once for each part.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(most, total // HOT_KEYS)
    hot = written(counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("long").alias("_parts")), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("_parts")), F.lit(0).cast("long")))
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0).cast("long")))))
    return dealt.drop("_parts").join(copies.drop("_parts"), [key, "_part"]).drop("_part")
