"""Streaming ingest: OTLP JSON lines to the span store, at least once, duplicates removed at read.

Offsets are committed after each micro-batch is written, so a failed write is repeated; lines that do
not parse go to a dead-letter table instead of stopping the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import otlp
from ..sources import store


def span_rows(requests: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Rows of the span table, from requests (project_id, resourceSpans)."""
    return otlp.stored(otlp.with_costs(otlp.with_messages(otlp.enriched(otlp.spans(requests))), prices))


def ingest(
    spark: SparkSession, source: str, path: str, checkpoint: str, project: str = "default", files: int = 100, fan_out: Callable[[DataFrame], None] | None = None, prices: DataFrame | None = None
) -> StreamingQuery:
    """Spans go to ``path``/spans; lines that are no request, and spans without ids or a start time, to ``path``/dead_letter.

    Extraction runs once: the rows are written to a batch table, from which the store, the dead letters and ``fan_out``
    are fed.  A batch that is run again overwrites that table, and its rows are duplicates that reads remove.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(source)
    parsed = raw.select("value", F.from_json("value", otlp.REQUEST, {"mode": "PERMISSIVE"}).alias("r"))

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        bad = F.col("r.resourceSpans").isNull()
        good = batch.filter(~bad).select(F.lit(project).alias("project_id"), "r.resourceSpans")
        staged = f"{path}/staged/batch={epoch}"
        span_rows(good, prices).withColumns({"ingested_at": F.current_timestamp(), "ingest_seq": F.monotonically_increasing_id()}).write.mode("overwrite").parquet(staged)
        rows = session.read.parquet(staged)
        whole = (F.length("trace_id") > 0) & (F.length("span_id") > 0) & F.col("timestamp_start").isNotNull()
        whole = F.coalesce(whole, F.lit(False))
        store.append(rows.filter(whole), f"{path}/spans")
        dead = batch.filter(bad).select("value").unionByName(rows.filter(~whole).select(F.col("raw_span").alias("value")))
        dead.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/dead_letter")
        if fan_out:
            fan_out(rows.filter(whole))

    return parsed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def deduplicated_stream(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Optional: drop spans seen within the watermark, with state bounded by ``delay``."""
    return rows.withWatermark("timestamp_start", delay).dropDuplicatesWithinWatermark(["project_id", "trace_id", "span_id"])


def ingest_metrics(spark: SparkSession, source: str, path: str, checkpoint: str, project: str = "default", files: int = 100) -> StreamingQuery:
    """Metric points of OTLP JSON lines, appended by project and day; the same guarantees as spans."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(source)
    parsed = raw.select("value", F.from_json("value", otlp.METRICS_REQUEST, {"mode": "PERMISSIVE"}).alias("r"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        bad = F.col("r.resourceMetrics").isNull()
        batch.filter(bad).select("value", F.lit(epoch).alias("epoch")).write.mode("append").parquet(f"{path}/metrics_dead_letter")
        rows = otlp.metrics(batch.filter(~bad).select(F.lit(project).alias("project_id"), "r.resourceMetrics"))
        store.append(rows, f"{path}/metrics", "timestamp")
        batch.unpersist()

    return parsed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def rate_counts(rows: DataFrame, key: str, time: str = "ingested_at", width: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """Requests of each key by fixed window, for limits; state is bounded by ``delay``.  Works on batches and streams."""
    marked = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return marked.groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
