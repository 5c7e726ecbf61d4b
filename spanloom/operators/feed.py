"""Conversation feed: blocks of messages with history marked and repeats removed.

A block row has trace_id, span_id, role, content_hash, is_output, is_history, quality, time,
message_index, entry_index.  Every step is a window or join by trace, so traces are the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the message format.
ROLES = {
    "developer": "system", "system": "system", "human": "user", "data": "user", "context": "user", "user": "user", "ai": "assistant", "bot": "assistant", "model": "assistant",
    "choice": "assistant", "tool_call": "assistant", "assistant": "assistant", "function": "tool", "ipython": "tool", "tool": "tool",
}
ORDER = ["birth_time", "span_id", "message_index", "entry_index"]


def role(column: str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(F.col(column)))), F.lit("user"))


def content_hash(kind: str, text: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.col(kind), F.trim(F.col(text))), 256)


def blocks(messages: DataFrame) -> DataFrame:
    """One row for each line of a message's text: its blocks here."""
    parts = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    out = messages.select("*", F.posexplode(parts).alias("entry_index", "block_text")).withColumn("role", role("role")).withColumn("kind", F.lit("text"))
    return out.withColumn("content_hash", content_hash("kind", "block_text"))


def duplicate_history(rows: DataFrame) -> DataFrame:
    """Within a trace and content, all but the best are history: output first, then the earliest."""
    best = Window.partitionBy("trace_id", "role", "content_hash").orderBy(F.col("is_output").desc(), "time", "span_id", "message_index", "entry_index")
    return rows.withColumn("is_history", F.col("is_history") | (F.row_number().over(best) > 1))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row for each identity: history only where there is nothing else is dropped, then the best quality stays."""
    same = Window.partitionBy("trace_id", "role", "content_hash")
    fresh = F.max((~F.col("is_history")).cast("int")).over(same)
    score = F.when(F.col("is_history"), 0).otherwise(100) + F.when(F.col("is_output"), 4).otherwise(0)
    best = same.orderBy(F.col("quality").desc(), "time", "span_id", "message_index", "entry_index")
    out = rows.withColumn("quality", score).withColumn("_fresh", fresh).filter("_fresh = 1").withColumn("_nth", F.row_number().over(best)).filter("_nth = 1")
    return out.withColumn("birth_time", F.col("time")).drop("_fresh", "_nth")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*ORDER)


def error_text(kind: Column, message: Column, trace: Column) -> Column:
    """Type and message, and the stack trace as a block behind them; null if there is none of them."""
    some = lambda c: F.nullif(c, F.lit(""))
    head = F.nullif(F.concat_ws(": ", some(kind), some(message)), F.lit(""))
    block = F.concat(F.lit("```\n"), some(trace), F.lit("\n```"))
    return F.nullif(F.concat_ws("\n\n", head, block), F.lit(""))


def leaf_errors(spans: DataFrame) -> DataFrame:
    """Spans in error without a child in error in the same trace, with the text of their exception; those without one say nothing."""
    keys = ["project_id", "trace_id", "span_id"]
    bad = spans.filter("status_code = 'ERROR'")
    child = bad.select("project_id", "trace_id", F.col("parent_span_id").alias("span_id")).filter("span_id is not null").distinct()
    said = bad.withColumn("text", error_text(F.col("exception_type"), F.col("exception_message"), F.col("exception_stacktrace"))).filter("text is not null")
    return said.join(child, keys, "left_anti").select(*keys, F.coalesce("timestamp_end", "timestamp_start").alias("time"), "text")


#: Events that bring output and input of a model, and attributes of each direction.
OUTPUT_EVENTS = ("gen_ai.choice", "gen_ai.content.completion")
INPUT_EVENTS = ("gen_ai.user.message", "gen_ai.assistant.message", "gen_ai.system.message", "gen_ai.tool.message", "gen_ai.content.prompt")
INPUT_SOURCES = (
    "input.value", "gcp.vertex.agent.llm_request", "gcp.vertex.agent.data", "ai.prompt", "lk.input_text", "lk.user_input", "lk.instructions", "lk.chat_ctx", "mlflow.spanInputs", "traceloop.entity.input",
    "pydantic_ai.all_messages", "request_data",
)
INPUT_PREFIXES = ("llm.input_messages", "gen_ai.input.", "gen_ai.prompt.")
OUTPUT_SOURCES = ("output.value", "gcp.vertex.agent.llm_response", "mlflow.spanOutputs", "traceloop.entity.output", "response_data")
OUTPUT_PREFIXES = ("llm.output_messages", "gen_ai.output.", "gen_ai.completion.", "ai.result.", "lk.response.")
#: What each sign of a better copy of a block adds to its quality.
QUALITY = {"fresh": 100, "finish": 10, "enrichment": 5, "output": 4, "tool_span": 3, "event": 2, "model": 1}


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def sourced(rows: DataFrame) -> DataFrame:
    """Flags by where a block comes from: ``source`` is the name of its event or attribute, ``from_event`` tells which."""
    s, event = F.col("source"), F.col("from_event")
    out_event, in_event = event & s.isin(*OUTPUT_EVENTS), event & s.isin(*INPUT_EVENTS)
    return rows.withColumns(
        {
            "output_event": out_event,
            "input_event": in_event,
            "input_source": in_event | (~event & _any([s.isin(*INPUT_SOURCES), *[s.startswith(p) for p in INPUT_PREFIXES]])),
            "output_source": out_event | (~event & _any([s.isin(*OUTPUT_SOURCES), *[s.startswith(p) for p in OUTPUT_PREFIXES]])),
            "protected": out_event | F.col("finish_reason").isNotNull() | F.coalesce(F.col("category") == "GenAIChoice", F.lit(False)),
        }
    )


def marked_history(rows: DataFrame) -> DataFrame:
    """Marks what a span repeats of earlier turns: one pass of windows by trace, then one condition for each rule.

    ``rows``: output of ``sourced`` with trace_id, span_id, parent_span_id, observation_type, role, kind, tool_id,
    time, span_start.  No protected block is ever history.  Adds ``history_rule``, the first rule that holds, and
    ``is_history``.  All windows share one partitioning by trace.
    """
    trace = Window.partitionBy("project_id", "trace_id")
    generation, root = F.coalesce(F.col("observation_type") == "generation", F.lit(False)), F.col("parent_span_id").isNull()
    kind, agent = F.col("kind"), F.coalesce(F.col("observation_type") == "agent", F.lit(False))
    over = lambda c: F.max(F.coalesce(c, F.lit(False))).over(trace)
    flags = rows.withColumns({"_agents": over(agent), "_events": over(F.col("output_event") | F.col("input_event")), "_results": over(generation & (kind == "tool_result"))})
    # a result is current if a protected block of its trace makes the call: partitioned by trace already, so no shuffle
    made = (kind == "tool_use") & F.col("protected")
    joined = flags.withColumn("_current", F.max(F.coalesce(made, F.lit(False))).over(Window.partitionBy("project_id", "trace_id", "tool_id")))
    turns = F.col("_agents") & F.col("_events") & F.col("_results")
    inner = generation & ~root
    rule = (
        F.when(F.col("protected"), None)
        .when(inner & (F.col("time") < F.col("span_start")), "timestamp")
        .when((kind != "tool_result") & (F.col("observation_type") == "chain") & (kind == "json"), "accumulator")
        .when((kind != "tool_result") & ~root & F.col("observation_type").isin("agent", "chain", "span") & F.col("input_event"), "accumulator")
        .when(F.col("_agents") & F.col("_events") & inner & (F.col("role").isin("user", "system") | ((F.col("role") == "assistant") & kind.isin("text", "thinking"))), "intermediate")
        .when(inner & (F.col("role") == "assistant") & ~F.col("from_event") & F.col("input_source"), "input_assistant")
        .when(turns & generation, "multi_turn")
        .when(turns & (kind == "tool_result") & F.col("tool_id").isNotNull() & ~F.col("_current"), "orphan_result")
    )
    return joined.withColumn("history_rule", rule).withColumn("is_history", F.col("history_rule").isNotNull()).drop("_agents", "_events", "_results", "_current")


def identity(rows: DataFrame) -> Column:
    """What makes two blocks of a trace the same: calls by name and input, results by call, others by role and content."""
    kind, content = F.col("kind"), F.col("content_hash")
    result = F.when(F.length("tool_id") > 0, F.concat(F.lit("i:"), "tool_id")).otherwise(F.concat(F.lit("c:"), content))
    return F.when(kind == "tool_use", F.concat_ws("\u0001", F.lit("call"), F.col("tool_name"), content)).when(kind == "tool_result", F.concat_ws("\u0001", F.lit("result"), result)).otherwise(F.concat_ws("\u0001", F.lit("block"), F.col("role"), content))


def quality(rows: DataFrame) -> Column:
    """Score of a copy of a block; columns that are missing add nothing."""
    signs = {
        "fresh": ~F.col("is_history"),
        "finish": F.col("finish_reason").isNotNull(),
        "enrichment": F.col("kind").isin("thinking", "redacted_thinking", "refusal"),
        "output": F.col("output_source"),
        "tool_span": (F.col("kind") == "tool_result") & (F.col("observation_type") == "tool"),
        "event": F.col("from_event"),
        "model": F.col("model").isNotNull(),
    }
    out = F.lit(0)
    for name, holds in signs.items():
        out = out + F.when(holds, QUALITY[name]).otherwise(0)
    return out


def completes(rows: DataFrame) -> Column:
    """Whether a block stands at the end of its span."""
    return (F.col("kind") != "tool_use") & (F.col("protected") | ((F.col("kind") == "tool_result") & (F.col("observation_type") == "tool")) | ((F.col("kind") == "json") & F.col("output_source")))


def effective_time(rows: DataFrame) -> Column:
    """When a block took effect: completions at the end of their span, others not before its start."""
    return F.when(completes(rows), F.greatest(F.coalesce("span_end", "time"), F.col("time"))).otherwise(F.greatest("time", "span_start"))


def marked_duplicates(rows: DataFrame) -> DataFrame:
    """Of equal content in a trace the best copy is news: output first, then completions, then the earliest.  Protected blocks and history take no part."""
    open_ = ~F.col("protected") & ~F.col("is_history")
    copies = Window.partitionBy("project_id", "trace_id", "content_hash", open_)
    best = copies.orderBy(F.col("output_source").desc(), F.coalesce(completes(rows), F.lit(False)).desc(), "birth_time", "span_id", "message_index", "entry_index")
    again = open_ & (F.row_number().over(best) > 1)
    out = rows.withColumn("_again", again)
    return out.withColumns({"history_rule": F.when(F.col("_again"), "duplicate").otherwise(F.col("history_rule")), "is_history": F.col("is_history") | F.col("_again")}).drop("_again")


def feed(rows: DataFrame) -> DataFrame:
    """The conversation of each trace: history marked, one copy of each identity, in total order."""
    marked = marked_history(rows if "protected" in rows.columns else sourced(rows))
    marked = marked_duplicates(marked.withColumn("birth_time", effective_time(marked)))
    scored = marked.withColumns({"identity": identity(marked), "quality": quality(marked)})
    same = Window.partitionBy("project_id", "trace_id", "identity")
    fresh = scored.filter(~F.col("is_history"))  # an identity that is only history has no row
    best = same.orderBy(F.col("quality").desc(), "birth_time", "span_id", "message_index", "entry_index")
    return fresh.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")


def project_feed(rows: DataFrame, limit: int) -> DataFrame:
    """Blocks of all conversations of a project, newest first; blocks of one span and time keep their order."""
    return rows.orderBy(F.col("time").desc(), "span_id", "message_index", "entry_index", "trace_id").limit(limit)


def totals(blocks_of: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens and cost of the spans that have a block in the feed, each span once."""
    keys = ["project_id", "trace_id", "span_id"]
    used = spans.join(blocks_of.select(*keys).distinct(), keys, "left_semi")
    return used.groupBy("project_id").agg(F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"), F.sum("cost_total").cast("double").alias("total_cost"))


def span_paths(spans: DataFrame) -> DataFrame:
    """Span ids from the root to each span of its trace; a parent that is not there begins the path, a cycle ends it.

    Parents are followed inside one trace, whose links are one row; only the paths leave it.  No path is longer than
    its trace.  Steps are nested by square roots, so a short path in a long trace ends early.
    """
    links = F.map_from_entries(F.array_distinct(F.collect_list(F.struct("span_id", "parent_span_id"))))
    rows = spans.select("project_id", "trace_id", "span_id", "parent_span_id").dropDuplicates(["project_id", "trace_id", "span_id"]).groupBy("project_id", "trace_id").agg(links.alias("links"))
    parent = lambda x: F.try_element_at(F.col("links"), x)
    steps = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size("links") + 1)).cast("int"))

    def step(state: Column, _: Column) -> Column:
        go = state["up"].isNotNull() & ~F.array_contains(state["path"], state["up"])
        onward = F.struct(F.concat(F.array(state["up"]), state["path"]).alias("path"), parent(state["up"]).alias("up"))
        return F.when(go, onward).otherwise(F.struct(state["path"].alias("path"), F.lit(None).cast("string").alias("up")))

    many = lambda state, _: F.when(state["up"].isNull(), state).otherwise(F.aggregate(steps, state, step))
    path = lambda x: F.aggregate(steps, F.struct(F.array(x).alias("path"), parent(x).alias("up")), many, lambda s: s["path"])
    paths = F.transform(F.map_keys("links"), lambda x: F.struct(x.alias("span_id"), path(x).alias("path")))
    return rows.select("project_id", "trace_id", F.explode(paths).alias("p")).select("project_id", "trace_id", "p.*")


def strippable(rows: DataFrame) -> Column:
    """Blocks that a later call may send again: input from attributes, and bundled input events."""
    return (F.col("input_source") & ~F.col("from_event")) | (F.col("from_event") & (F.col("source") == "gen_ai.input.messages"))


def prefix_history(rows: DataFrame) -> DataFrame:
    """Marks blocks of a session's later traces that replay earlier ones, in order.

    ``rows``: session_id, trace_id, span_id, trace_start, message_index, role, content_hash.  Sequential by
    nature: each span is matched against what the earlier traces added, so a session is the unit; only hashes
    travel, and a block is found by bisection.  System blocks neither match nor end a match, nor do blocks whose
    column ``strippable`` (if there; see ``strippable``) is false: single events keep their own times.

    A block that other spans of its trace repeat is added once, but as often as one message says it: a replay has all of
    these.  With a column ``entry_index`` blocks of a message are matched in its order, and a block delivered twice is one.
    """
    from bisect import bisect_left
    from collections import Counter

    import pandas as pd

    placed = "entry_index" in rows.columns

    def mark(session: pd.DataFrame) -> pd.DataFrame:
        order = ["trace_start", "trace_id", "span_id", "message_index"]
        session = session.sort_values([*order, "entry_index", "role", "content_hash"] if placed else order, kind="stable")
        places: dict[tuple[str, str], list[int]] = {}  # where a block was said before, ascending
        said, marks = 0, []
        for _, trace in session.groupby(["trace_start", "trace_id"], sort=False):
            fresh: dict[tuple[str, str, int], None] = {}  # role, hash and how often its message said it before
            at, matching, span, message, last = 0, True, None, None, None
            again: Counter[tuple[str, str]] = Counter()
            for s, r, h, may, m, e in zip(*[trace[c] for c in ("span_id", "role", "content_hash", "strippable", "message_index", "entry_index")], strict=True):
                if placed and (s, m, e, r, h) == last:
                    marks.append(marks[-1])
                    continue
                last = (s, m, e, r, h)
                if s != span:
                    at, matching, span, message = 0, True, s, None
                if m != message:
                    message = m
                    again.clear()
                hit = None
                if matching and may and r != "system":
                    before = places.get((r, h), [])
                    k = bisect_left(before, at)
                    hit = before[k] if k < len(before) else None
                    matching = hit is not None
                marks.append(hit is not None)
                if hit is not None:
                    at = hit + 1
                elif r != "system":
                    fresh[(r, h, again[r, h])] = None
                    again[r, h] += 1
            for r, h, _ in fresh:  # a trace that only replays adds nothing
                places.setdefault((r, h), []).append(said)
                said += 1
        return session.drop(columns=["strippable", "entry_index"]).assign(is_history=marks)

    schema = "session_id string, trace_id string, span_id string, trace_start timestamp, message_index long, role string, content_hash string, is_history boolean"
    may = F.col("strippable") if "strippable" in rows.columns else F.lit(True)
    entry = F.col("entry_index").cast("long") if placed else F.lit(0).cast("long")
    return rows.withColumns({"strippable": may, "entry_index": entry}).select("strippable", "entry_index", "session_id", "trace_id", "span_id", F.col("trace_start").cast("timestamp"), F.col("message_index").cast("long"), "role", "content_hash").groupBy("session_id").applyInPandas(mark, schema)


def merged_tools(tools: DataFrame) -> DataFrame:
    """One definition for each name: the best described is kept, an empty description is filled from the others."""
    score = F.when(F.length(F.coalesce("description", F.lit(""))) > 0, 2).otherwise(0) + F.when(F.col("parameters").isNotNull(), 2).otherwise(0)
    rows = tools.withColumn("quality", score)
    best = F.struct(F.col("quality"), F.coalesce("parameters", F.lit("")).alias("p"), F.coalesce("description", F.lit("")).alias("d"))
    return rows.groupBy("name").agg(F.max_by("parameters", best).alias("parameters"), F.coalesce(F.max_by("description", F.when(F.length("description") > 0, best)), F.lit("")).alias("description")).orderBy("name")


def merged_definitions(tools: DataFrame, definition: str = "definition") -> DataFrame:
    """One full definition for each tool name.  Equal definitions are one row before the merge, and a name with
    many different ones is merged in parts first, so no task holds them all."""
    import json

    import pandas as pd

    from ..functions.messages import merged_tool, named_tools

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = merged_tool([json.loads(x) for x in rows["definition"]])
        return pd.DataFrame({"name": [key[0]], "definition": [json.dumps(one, sort_keys=True)]})

    each = tools.select(F.explode(named_tools(F.col(definition))).alias("t")).select("t.name", "t.definition").distinct()
    parts = each.withColumn("part", F.pmod(F.xxhash64("definition"), F.lit(64))).groupBy("name", "part").applyInPandas(merge, "name string, definition string")
    return parts.groupBy("name").applyInPandas(merge, "name string, definition string")
