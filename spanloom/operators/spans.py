"""Span listings, keyset feeds, events, links, counts, options, deletion and retention."""

from __future__ import annotations

import base64
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import KEYS, conformed
from .dedup import first_rows

MAX_SPANS, MAX_OPTIONS = 10_000, 100
EVENTS = "array<struct<name: string, timestamp: string, attributes: map<string, string>>>"
LINKS = "array<struct<trace_id: string, span_id: string, attributes: map<string, string>>>"


def _listed(spans: DataFrame, where: Column | None, observations_only: bool) -> DataFrame:
    rows = first_rows(spans)
    if where is not None:
        rows = rows.filter(where)
    return rows.filter("observation_type <> 'span'") if observations_only else rows


def list_spans(
    spans: DataFrame, where: Column | None = None, order: str = "timestamp_start", descending: bool = True, limit: int = 50, number: int = 1, observations_only: bool = False, project: str | None = None
) -> DataFrame:
    """A page of spans: first its keys from the columns that order and filter need, then the whole rows of these keys."""
    spans = conformed(spans)
    spans = spans if project is None else spans.filter(F.col("project_id") == project)
    by = [F.col(order).desc() if descending else F.col(order), *KEYS]
    keys = _listed(spans, where, observations_only).select(*KEYS, order).orderBy(*by).offset((max(number, 1) - 1) * limit).limit(limit)
    return first_rows(spans.join(F.broadcast(keys.select(*KEYS)), KEYS, "left_semi")).orderBy(*by)


def count_spans(spans: DataFrame, where: Column | None = None, observations_only: bool = False) -> DataFrame:
    """Number of spans of all pages."""
    return _listed(conformed(spans), where, observations_only).agg(F.count("*").alias("total"))


def feed(rows: DataFrame, limit: int, before: tuple[datetime, str] | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Newest first by (ingested_at, span_id), strictly before the cursor; times are half-open.  Keys first, as for lists."""

    def found(of: DataFrame) -> DataFrame:
        out = first_rows(of)
        if since is not None:
            out = out.filter(F.col("timestamp_start") >= F.lit(since))
        if until is not None:
            out = out.filter(F.col("timestamp_start") < F.lit(until))
        if before is not None:
            at = F.lit(before[0]).cast(of.schema["ingested_at"].dataType)
            out = out.filter(F.struct("ingested_at", "span_id") < F.struct(at.alias("ingested_at"), F.lit(before[1]).alias("span_id")))
        return out

    by = [F.col("ingested_at").desc(), F.col("span_id").desc(), F.col("trace_id").desc()]
    keys = found(rows).select(*KEYS, "ingested_at").orderBy(*by).limit(limit).select(*KEYS)
    return first_rows(rows.join(F.broadcast(keys), KEYS, "left_semi")).orderBy(*by)


def next_cursor(page: DataFrame, limit: int) -> str | None:
    """The cursor behind a page that was asked for with ``limit + 1`` rows; None if nothing follows."""
    rows = page.select("ingested_at", "span_id").limit(limit + 1).collect()
    return cursor(rows[limit - 1][0], rows[limit - 1][1]) if len(rows) > limit else None


def cursor(ingested_at: datetime, span_id: str) -> str:
    micros = int((ingested_at - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    return base64.urlsafe_b64encode(f"{micros}:{span_id}".encode()).decode().rstrip("=")


def parse_cursor(text: str) -> tuple[datetime, str]:
    micros, _, span_id = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode().partition(":")
    return datetime(1970, 1, 1) + timedelta(microseconds=int(micros)), span_id


def spans_for_trace(spans: DataFrame, project: str, trace: str) -> DataFrame:
    own = spans.filter((F.col("project_id") == project) & (F.col("trace_id") == trace))
    return first_rows(own).orderBy("timestamp_start", "span_id").limit(MAX_SPANS)


def get_span(spans: DataFrame, project: str, trace: str, span: str) -> DataFrame:
    return first_rows(spans.filter((F.col("project_id") == project) & (F.col("trace_id") == trace) & (F.col("span_id") == span)))


def unnested(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """A row for each element of a JSON array of events or links, with its place; ids of a link are linked_trace_id and linked_span_id."""
    out = rows.select(*KEYS, F.posexplode(F.from_json(column, kind)).alias("position", "item"))
    fields = out.schema["item"].dataType.names
    return out.select(*KEYS, "position", *[F.col(f"item.{x}").alias(f"linked_{x}" if x in KEYS else x) for x in fields])


def counts(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Event and link counts for each asked key, 0 for spans that are not there."""
    size = lambda c: F.coalesce(F.json_array_length(c), F.lit(0)).cast("long")
    own = first_rows(rows).select(*KEYS, "events", "links")
    return keys.distinct().join(own, KEYS, "left").select(*KEYS, size("events").alias("event_count"), size("links").alias("link_count"))


def options(rows: DataFrame, column: str, counted: list[str], exact: bool = True, limit: int = MAX_OPTIONS) -> DataFrame:
    """The most frequent values of a column and how many different ``counted`` have them."""
    rows = rows.filter(F.col(column).isNotNull())
    n = F.count("*").cast("long") if exact else F.approx_count_distinct(F.struct(*counted)).cast("long")
    rows = rows.select(F.col(column).alias("value"), *counted)
    found = (rows.distinct() if exact else rows).groupBy("value").agg(n.alias("n"))
    return found.orderBy(F.col("n").desc(), "value").limit(limit)


def tag_options(rows: DataFrame, tags: str, counted: list[str], exact: bool = True) -> DataFrame:
    return options(rows.withColumn("_tag", F.explode(tags)), "_tag", counted, exact)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """What deletion leaves."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def retained_by_age(rows: DataFrame, now: datetime, max_age: timedelta) -> DataFrame:
    return rows.filter(F.col("timestamp_start") >= F.lit(now - max_age).cast("timestamp_ntz"))


def retained_by_count(rows: DataFrame, most: int) -> DataFrame:
    """All rows of the ``most`` newest spans: distinct spans by start, then key.

    The cut is found from counts by day; only spans of the day it falls into are ordered.
    """
    spans = rows.groupBy(*KEYS).agg(F.min("timestamp_start").alias("_start")).withColumn("_day", F.to_date("_start"))
    days = spans.groupBy("_day").agg(F.count("*").alias("n"))
    newer = days.alias("a").join(days.alias("b"), F.col("b._day") > F.col("a._day"), "left").groupBy("a._day", "a.n").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("newer"))
    edge = newer.filter((F.col("newer") < most)).select("_day", "n", "newer")
    placed = spans.join(F.broadcast(edge), "_day")
    full = placed.filter(F.col("newer") + F.col("n") <= most).select(*KEYS)
    cut = placed.filter(F.col("newer") + F.col("n") > most)
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("_day").orderBy(F.col("_start").desc(), *KEYS))
    part = cut.withColumn("_nth", nth).filter(F.col("_nth") + F.col("newer") <= most).select(*KEYS)
    return rows.join(full.unionAll(part), KEYS, "left_semi")
