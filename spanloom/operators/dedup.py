"""One row for each span: the first ingested, by a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import KEYS, ORDER

TIE = ("timestamp_start", "timestamp_end", "input_tokens", "output_tokens")


def first_rows(rows: DataFrame, keys: list[str] = KEYS, order: list[str] = ORDER, last: bool = False) -> DataFrame:
    """``last`` keeps the latest version instead.  Null keys form a group like any other.

    Rows that tie in ``order`` are told apart by a hash of what most tells versions apart, so a page reads few columns.
    """
    tie = F.xxhash64(*[c for c in TIE if c in rows.columns])
    by = [x.desc() if last else x for x in (*[F.col(c) for c in order if c in rows.columns], tie)]
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_nth = 1").drop("_nth")


def unique_spans(rows: DataFrame) -> DataFrame:
    """Spans of each project without ordering rows: counting is blind to duplicates."""
    return rows.select(*KEYS).distinct().groupBy("project_id").agg(F.count("*").alias("n_spans"))
