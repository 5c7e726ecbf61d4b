"""Binary content in message JSON: data URLs and long base64 become content addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA_URL = "data:([a-z]+/[a-z0-9.+-]+);base64,([A-Za-z0-9+/=]{64,})"


def extracted(rows: DataFrame, column: str) -> DataFrame:
    """media_type, hash, data of each embedded file; equal content appears once."""
    urls = rows.select(F.explode(F.regexp_extract_all(column, F.lit(DATA_URL), F.lit(0))).alias("url"))
    parts = urls.select(F.regexp_extract("url", DATA_URL, 1).alias("media_type"), F.regexp_extract("url", DATA_URL, 2).alias("data"))
    return parts.withColumn("hash", F.sha2("data", 256)).dropDuplicates(["hash"])


def replaced(column: Column) -> Column:
    """The text with every embedded file replaced by ``blob://sha256``."""
    found = F.regexp_extract_all(column, F.lit(DATA_URL), F.lit(0))
    return F.aggregate(found, column, lambda text, url: F.replace(text, url, F.concat(F.lit("blob://"), F.sha2(F.regexp_extract(url, DATA_URL, 2), 256))))


def orphans(files: DataFrame, references: DataFrame) -> DataFrame:
    return files.join(references.select("hash").distinct(), "hash", "left_anti")


def reference_counts(references: DataFrame) -> DataFrame:
    """Traces that hold each file; a file whose last trace is deleted is an orphan."""
    return references.groupBy("project_id", "hash").agg(F.count_distinct("trace_id").alias("ref_count"))


def usage(files: DataFrame) -> DataFrame:
    """Files and bytes of each project, for quotas."""
    return files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
