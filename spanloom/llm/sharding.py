"""Sharding by jump consistent hashing: a stable key alone decides the shard, without a ring table.

Going from n to n + 1 shards moves a 1 / (n + 1) share of the keys, all into the new shard.
Null keys take the hash of their text instead, so they spread as well.  Equal rows share a shard and
get slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytes import mix
from .storage import written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys onto 0 .. shards - 1."""
    key = mix(keys.astype(np.int64).view(np.uint64))
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while (live := np.flatnonzero(ahead < shards)).size:
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = np.floor((at[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
    return at


def jump_column(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return shard(key)


def shard_documents(docs: DataFrame, shards: int = 40, slot_blocks: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard of every row.

    Slots count from 0 without gaps in each shard.  A shard is cut by the key's hash into
    ``slot_blocks`` blocks that are numbered apart and offset by the counts of the blocks before, so
    no task sorts a whole shard; a row's number in its table is part of the hash, so equal rows spread too.  The
    table of offsets has shards * slot_blocks rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    rows = written(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            jump_column(key, shards).alias("shard"),
            jump_column(key, shards + 1).alias("grown_shard"),
            F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(slot_blocks)).cast("int").alias("block"),
        ),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, files_per_shard: int = 1) -> None:
    """Write the documents themselves as one folder for each shard, in ``files_per_shard`` files."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    dealt = docs.withColumn("shard", jump_column(key, shards)).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(files_per_shard)))
    dealt.repartition(shards * files_per_shard, "shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
