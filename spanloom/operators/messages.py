"""Spans that carry a conversation: of a span, a session or a trace, and of a whole project by pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import conformed
from .dedup import first_rows
from .spans import feed
from .traces import TRACE, traces_of_sessions

COLUMNS = (
    "project_id trace_id span_id parent_span_id session_id timestamp_start timestamp_end ingested_at messages_json tool_definitions_json tool_names_json gen_ai_request_model gen_ai_system status_code "
    "exception_type exception_message exception_stacktrace observation_type input_tokens output_tokens total_tokens cost_total"
).split()


def has_content() -> Column:
    """Whether a span has messages, tools, or an error to show."""
    filled = F.lit(False)
    for c in ("messages_json", "tool_definitions_json", "tool_names_json"):
        filled = filled | (F.coalesce(F.col(c), F.lit("[]")) != "[]")
    return filled | F.coalesce(F.col("status_code") == "ERROR", F.lit(False))


def get_messages(spans: DataFrame, project: str, trace_id: str | None = None, session_id: str | None = None, span_id: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """By span if one is named, else by all traces of the session, else by trace; oldest first, times half-open.

    A named span is returned whatever it holds, and only of the trace if that is named too.
    """
    own = conformed(spans).filter(F.col("project_id") == project)
    if span_id is not None:
        own = own.filter(F.col("span_id") == span_id)
        own = own if trace_id is None else own.filter(F.col("trace_id") == trace_id)
    elif session_id is not None:
        own = own.join(traces_of_sessions(own, project, [session_id]), TRACE, "left_semi")
    elif trace_id is not None:
        own = own.filter(F.col("trace_id") == trace_id)
    rows = first_rows(own.select(*COLUMNS, "ingest_seq"))
    if span_id is None:
        rows = rows.filter(has_content())
    kind = rows.schema["timestamp_start"].dataType
    if since is not None:
        rows = rows.filter(F.col("timestamp_start") >= F.lit(since).cast(kind))
    if until is not None:
        rows = rows.filter(F.col("timestamp_start") < F.lit(until).cast(kind))
    return rows.select(*COLUMNS).orderBy("timestamp_start", "trace_id", "span_id")


def project_messages(spans: DataFrame, project: str, limit: int, before: tuple[datetime, str] | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Newest ingested first, strictly before the cursor; see :func:`spanloom.operators.spans.feed`."""
    own = conformed(spans).filter(F.col("project_id") == project).select(*COLUMNS, "ingest_seq")
    return feed(first_rows(own).filter(has_content()).select(*COLUMNS), limit, before, since, until)
