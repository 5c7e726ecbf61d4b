"""Traces and sessions: pages of keys first, then the spans of those keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import TOKENS, conformed
from .dedup import first_rows
from .tokens import token_roots

TRACE = ["project_id", "trace_id"]
SESSION = ["project_id", "session_id"]
TRACE_ORDER = {"start_time": "start_time", "end_time": "end_time", "duration_ms": "duration_ms", "total_cost": "total_cost", "observation_count": "observation_count", "total_tokens": "total_tokens"}
SESSION_ORDER = {"start_time": "start_time", "total_cost": "total_cost", "trace_count": "trace_count", "span_count": "span_count", "end_time": "end_time", "observation_count": "observation_count"}


def _millis(start: str, end: str) -> Column:
    """Boundaries of milliseconds crossed, not elapsed time cut off."""
    return F.unix_millis(F.col(end).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp"))


def _first(column: str, where: Column | None = None, last: bool = False) -> Column:
    """The value of the earliest (or the latest) row that has one."""
    has = F.col(column).isNotNull()
    return (F.max_by if last else F.min_by)(F.when(has if where is None else has & where, F.col(column)), F.when(has if where is None else has & where, F.struct("timestamp_start", "span_id")))


#: Sums of the spans whose tokens count: output and column.
SUMS = {c: c for c in TOKENS} | {"input_cost": "cost_input", "output_cost": "cost_output", "cache_read_cost": "cost_cache_read", "cache_write_cost": "cost_cache_write", "reasoning_cost": "cost_reasoning", "total_cost": "cost_total"}


def totals(counted: DataFrame, keys: list[str]) -> DataFrame:
    return counted.groupBy(*keys).agg(*[F.sum(c).cast("long" if c in TOKENS else "double").alias(name) for name, c in SUMS.items()])


def with_totals(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.join(sums, keys, "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0).cast("long" if c in TOKENS else "double")) for name, c in SUMS.items()})


def summaries(rows: DataFrame) -> DataFrame:
    """A row for each trace of deduplicated spans, without totals."""
    root = F.col("parent_span_id").isNull()
    out = rows.groupBy(*TRACE).agg(
        F.coalesce(_first("span_name", root), _first("span_name")).alias("trace_name"),
        F.min("timestamp_start").alias("start_time"),
        F.max(F.coalesce("timestamp_end", "timestamp_start")).alias("end_time"),
        _first("session_id").alias("session_id"),
        _first("user_id").alias("user_id"),
        _first("environment").alias("environment"),
        F.count("*").cast("long").alias("span_count"),
        F.count(F.when(F.col("observation_type") != "span", 1)).cast("long").alias("observation_count"),
        F.coalesce(F.bool_or(F.col("status_code") == "ERROR"), F.lit(False)).alias("has_error"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        _first("metadata", root).alias("metadata"),
        F.coalesce(_first("input_preview", root), _first("input_preview")).alias("input_preview"),
        F.coalesce(_first("output_preview", root), _first("output_preview", last=True)).alias("output_preview"),
    )
    return out.withColumn("duration_ms", _millis("start_time", "end_time"))


def page(rows: DataFrame, order: str, descending: bool, limit: int, number: int, ties: list[str]) -> DataFrame:
    number = max(number, 1)
    by = F.col(order).desc() if descending else F.col(order).asc()
    return rows.orderBy(by, *ties).offset((number - 1) * limit).limit(limit)


def _scoped(spans: DataFrame, project: str | None) -> DataFrame:
    """Below the window that removes duplicates only the project may be tested: it is part of their key."""
    spans = conformed(spans)
    return spans if project is None else spans.filter(F.col("project_id") == project)


def _keyed(found: DataFrame, keys: list[str], order: str, descending: bool, limit: int, number: int) -> DataFrame:
    """Keys of a page.  Only what the order needs is computed for all; the rest is pruned from the plan."""
    return page(found.select(*keys, order), order, descending, limit, number, keys).select(*keys)


def _matched(rows: DataFrame, where: Column | None, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that match, and all rows of their keys."""
    if where is None:
        return rows, rows
    matched = rows.filter(where)
    return matched, rows.join(matched.select(*keys).distinct(), keys, "left_semi")


def list_traces(
    spans: DataFrame, where: Column | None = None, order: str = "start_time", descending: bool = True, limit: int = 50, number: int = 1, genai_only: bool = False, project: str | None = None
) -> DataFrame:
    """A page of traces that have a matching row; counts cover all their spans, totals the matching ones.

    First the keys of the page from the few columns that its order needs, then all columns for these keys alone; the
    keys are at most ``limit``, so they are broadcast.
    """
    spans = _scoped(spans, project)

    def found(of: DataFrame) -> DataFrame:
        matched, shown = _matched(first_rows(of), where, TRACE)
        out = with_totals(summaries(shown), totals(token_roots(matched, of), TRACE), TRACE)
        return out.filter("observation_count > 0") if genai_only else out

    keys = _keyed(found(spans), TRACE, TRACE_ORDER[order], descending, limit, number)
    own = found(spans.join(F.broadcast(keys), TRACE, "left_semi"))
    return page(own, TRACE_ORDER[order], descending, limit, 1, TRACE)


def count_traces(spans: DataFrame, where: Column | None = None, genai_only: bool = False, project: str | None = None) -> DataFrame:
    """Number of traces of all pages; blind to duplicates where nothing is filtered."""
    spans = _scoped(spans, project)
    matched, shown = _matched(spans if where is None else first_rows(spans), where, TRACE)
    keys = shown.filter("observation_type <> 'span'") if genai_only else matched
    return keys.select(*TRACE).distinct().agg(F.count("*").alias("total"))


def get_trace(spans: DataFrame, project: str, trace: str) -> DataFrame:
    own = conformed(spans).filter((F.col("project_id") == project) & (F.col("trace_id") == trace))
    rows = first_rows(own)
    return with_totals(summaries(rows), totals(token_roots(rows, own), TRACE), TRACE)


def traces_of_sessions(spans: DataFrame, project: str, sessions: list[str]) -> DataFrame:
    """Distinct trace ids; any row may carry the session, so no row needs to be the first."""
    return spans.filter((F.col("project_id") == project) & F.col("session_id").isin(sessions)).select(*TRACE).distinct()


def traces_for_session(spans: DataFrame, project: str, session: str) -> DataFrame:
    own = conformed(spans).join(traces_of_sessions(spans, project, [session]), TRACE, "left_semi")
    rows = first_rows(own)
    return with_totals(summaries(rows), totals(token_roots(rows, own), TRACE), TRACE).orderBy(F.col("start_time").desc(), "trace_id")


def _session_rows(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*SESSION).agg(
        _first("user_id").alias("user_id"),
        _first("environment").alias("environment"),
        F.min("timestamp_start").alias("start_time"),
        F.max(F.coalesce("timestamp_end", "timestamp_start")).alias("end_time"),
        F.count_distinct("trace_id").cast("long").alias("trace_count"),
        F.count("*").cast("long").alias("span_count"),
        F.count(F.when(F.col("observation_type") != "span", 1)).cast("long").alias("observation_count"),
    )
    return out.withColumn("duration_ms", _millis("start_time", "end_time"))


def list_sessions(spans: DataFrame, where: Column | None = None, order: str = "start_time", descending: bool = True, limit: int = 50, number: int = 1, project: str | None = None) -> DataFrame:
    """Only rows that carry the session id count here; :func:`get_session` takes whole traces.  Keys first, as for traces."""
    spans = _scoped(spans, project)

    def found(rows: DataFrame, evidence: DataFrame) -> DataFrame:
        matched, shown = _matched(first_rows(rows).filter(F.col("session_id").isNotNull()), where, SESSION)
        return with_totals(_session_rows(shown), totals(token_roots(matched, evidence), SESSION), SESSION)

    keys = _keyed(found(spans, spans), SESSION, SESSION_ORDER[order], descending, limit, number)
    traces = spans.join(F.broadcast(keys), SESSION, "left_semi").select(*TRACE).distinct()
    own = spans.join(traces, TRACE, "left_semi")  # whole traces: versions of a span may differ, and evidence lies beside it
    out = found(own, own).join(F.broadcast(keys), SESSION, "left_semi")
    return page(out, SESSION_ORDER[order], descending, limit, 1, SESSION)


def count_sessions(spans: DataFrame, where: Column | None = None, project: str | None = None) -> DataFrame:
    rows = _scoped(spans, project)
    rows = (rows if where is None else first_rows(rows)).filter(F.col("session_id").isNotNull())
    return (rows if where is None else rows.filter(where)).select(*SESSION).distinct().agg(F.count("*").alias("total"))


def get_session(spans: DataFrame, project: str, session: str) -> DataFrame:
    own = conformed(spans).join(traces_of_sessions(spans, project, [session]), TRACE, "left_semi")
    rows = first_rows(own).withColumn("session_id", F.lit(session))
    return with_totals(_session_rows(rows), totals(token_roots(rows, own), SESSION), SESSION)
