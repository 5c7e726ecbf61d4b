"""Project statistics: counts, shares, and trends in buckets of fixed elapsed time."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import first_rows
from .tokens import token_roots
from .traces import TRACE, _millis

TOP = 10


def between(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Both ends included."""
    t = F.col("timestamp_start")
    return rows.filter((t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz")))


def main(spans: DataFrame, start: datetime, end: datetime) -> DataFrame:
    rows = between(first_rows(spans), start, end)
    counts = rows.groupBy("project_id").agg(
        F.count_distinct("trace_id").alias("traces"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("user_id").alias("users"),
        F.count("*").alias("spans"),
        F.count(F.when(F.col("observation_type") != "span", 1)).alias("observations"),
        F.count(F.when(F.col("status_code") == "ERROR", 1)).alias("errors"),
    )
    used = token_roots(rows, spans).groupBy("project_id").agg(
        F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"), F.round(F.sum("cost_total").cast("double"), 4).alias("total_cost")
    )
    out = counts.join(used, "project_id", "left")
    return out.withColumns({"input_tokens": F.coalesce("input_tokens", F.lit(0)), "output_tokens": F.coalesce("output_tokens", F.lit(0)), "total_cost": F.coalesce("total_cost", F.lit(0.0))})


def previous_traces(spans: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Traces of the period of equal length before; a span exactly at ``start`` counts in both."""
    return between(spans, start - (end - start), start).groupBy("project_id").agg(F.count_distinct("trace_id").alias("traces"))


def average_duration(spans: DataFrame, start: datetime, end: datetime) -> DataFrame:
    rows = between(spans, start, end)
    each = rows.groupBy(*TRACE).agg(F.min("timestamp_start").alias("a"), F.max(F.coalesce("timestamp_end", "timestamp_start")).alias("b"))
    return each.groupBy("project_id").agg(F.round(F.avg(_millis("a", "b")), 3).alias("avg_duration_ms"))


def shares(rows: DataFrame, column: str, counted: Column, top: int = TOP) -> DataFrame:
    """The top values of a column by ``counted``, with their share of all in percent."""
    each = rows.filter(F.col(column).isNotNull()).groupBy("project_id", F.col(column).alias("value")).agg(counted.cast("long").alias("n"))
    total = each.groupBy("project_id").agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("n").desc(), "value"))
    ranked = each.withColumn("nth", nth).filter(F.col("nth") <= top)
    return ranked.join(total, "project_id").select("project_id", "value", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 1).alias("share"))


def frameworks(spans: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Share of frameworks over traces that have an observation."""
    rows = between(spans, start, end)
    own = rows.filter("observation_type <> 'span'").select(*TRACE).distinct()
    return shares(rows.join(own, TRACE, "left_semi"), "framework", F.count_distinct("trace_id"))


def models(spans: DataFrame, start: datetime, end: datetime) -> DataFrame:
    rows = token_roots(between(first_rows(spans), start, end), spans)
    return shares(rows, "gen_ai_request_model", F.sum(F.col("input_tokens") + F.col("output_tokens")))


def recent(spans: DataFrame, now: datetime, minutes: int = 5) -> DataFrame:
    return between(spans, now - timedelta(minutes=minutes), now).groupBy("project_id").agg(F.count_distinct("trace_id").alias("traces"))


def buckets(start: datetime, end: datetime, daily: bool, zone: str = "UTC") -> list[tuple[datetime, datetime]]:
    """(start, end) in UTC: the first is cut to the hour or day in ``zone``, each steps by 1 or 24 hours of elapsed time."""
    try:
        tz = ZoneInfo(zone)
    except Exception:  # an unknown zone counts as UTC
        tz = ZoneInfo("UTC")
    local = start.replace(tzinfo=UTC).astimezone(tz)
    cut = local.replace(hour=0, minute=0, second=0, microsecond=0, fold=0) if daily else local.replace(minute=0, second=0, microsecond=0)
    at, step = cut.astimezone(UTC).replace(tzinfo=None), timedelta(hours=24 if daily else 1)
    out = []
    while at <= end:
        out.append((at, at + step))
        at += step
    return out


def trend(rows: DataFrame, start: datetime, end: datetime, daily: bool, value: Column, name: str, zone: str = "UTC") -> DataFrame:
    """``value`` for each bucket, 0 for empty ones.  A row finds its bucket by division, so the join is by equality."""
    first = buckets(start, end, daily, zone)
    if not first:
        first = [(start, start)]
    origin, step, n = first[0][0], 86_400 if daily else 3_600, len(first)
    spark = rows.sparkSession
    frame = spark.range(n).select(F.col("id").alias("bucket"), F.expr(f"timestamp_ntz '{origin:%Y-%m-%d %H:%M:%S}' + make_dt_interval(0, 0, 0, id * {step})").alias("bucket_start"))
    seconds = (F.unix_micros(F.col("timestamp_start").cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp_ntz").cast("timestamp"))) / 1_000_000
    found = between(rows, start, end).withColumn("bucket", F.floor(seconds / step).cast("long")).groupBy("bucket").agg(value.alias(name))
    return frame.join(found, "bucket", "left").select("bucket_start", F.coalesce(name, F.lit(0)).alias(name)).orderBy("bucket_start")
