"""Token attribution trees, filters, cursors, buckets, ingest and streaming on rows of our own."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanloom.functions import blobs, classify, normalize, otlp
from spanloom.operators import filters, spans, stats, traces
from spanloom.operators.dedup import first_rows
from spanloom.operators.tokens import token_roots
from spanloom.streaming.ingest import deduplicated_stream, ingest

T = datetime(2024, 1, 1)
SCHEMA = "project_id string, trace_id string, span_id string, parent_span_id string, session_id string, user_id string, environment string, span_name string, observation_type string, status_code string, timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, input_tokens long, output_tokens long, cost_total decimal(18,6), ingested_at timestamp_ntz, tb1 int, tb2 int, tb3 int, tb4 int, tb5 int"


def tree(spark, *rows):
    """(span, parent, type, tokens)"""
    return spark.createDataFrame([("p", "t", s, p, None, None, None, s, k, "OK", T, None, n, 0, None, T, 0, 0, 0, 0, 0) for s, p, k, n in rows], SCHEMA)


def kept(df):
    return sorted(r.span_id for r in token_roots(first_rows(df), df).collect())


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("a", None, "agent", 9), ("g", "a", "generation", 9), ("h", "g", "generation", 9)], ["h"]),
        ([("a", None, "agent", 9), ("g", "a", "generation", 4), ("h", "a", "generation", 5)], ["g", "h"]),
        ([("a", None, "generation", 9), ("b", "a", "generation", 9), ("c", "b", "generation", 9)], ["c"]),
        ([("a", None, "agent", 0), ("b", "a", "span", 0)], []),
        ([("a", None, "agent", 7), ("b", "a", "span", 0)], ["a"]),
        ([("a", None, "agent", 7), ("b", "a", "span", 7)], ["a"]),
        ([("a", None, "generation", 0), ("b", "a", "generation", 5)], ["b"]),
        ([("a", None, None, 5)], []),
        ([("a", "gone", "span", 5)], ["a"]),
    ],
)
def test_token_trees(spark, rows, expected):
    assert kept(tree(spark, *rows)) == expected


def test_duplicates_count_once(spark):
    df = tree(spark, ("g", None, "generation", 5), ("g", None, "generation", 5))
    assert traces.list_traces(df).first().total_tokens == 5


def test_evidence_outside_the_filter(spark):
    df = tree(spark, ("a", None, "generation", 5), ("b", "a", "generation", 3))
    row = traces.list_traces(df, F.col("span_id") == "a").first()
    assert (row.span_count, row.total_tokens) == (2, 0)


def test_paths_of_a_long_chain(spark):
    from spanloom.operators.feed import span_paths

    chain = [(f"s{k}", f"s{k - 1}" if k else None, "span", 0) for k in range(400)]
    got = {r.span_id: r.path for r in span_paths(tree(spark, *chain, ("x", "y", "span", 0), ("y", "x", "span", 0))).collect()}
    assert all(got[f"s{k}"] == [f"s{i}" for i in range(k + 1)] for k in range(400))
    assert got["x"] == ["y", "x"] and got["y"] == ["x", "y"]


def test_filters_are_checked():
    with pytest.raises(filters.FilterError):
        filters.parse_filters('[{"type":"string","column":"x","operator":"=","value":"1"}]', {})
    with pytest.raises(filters.FilterError):
        filters.parse_filters(json.dumps([{}] * 51), {})
    assert filters.order_by("a:asc", {"a": "b"}, "a") == ("b", False)


def test_cursor():
    at = datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert spans.parse_cursor(spans.cursor(at, "x:y")) == (at, "x:y")


def test_buckets_step_by_elapsed_time():
    days = stats.buckets(datetime(2024, 3, 30), datetime(2024, 4, 2), True, "Europe/Berlin")
    assert {(b - a).total_seconds() for a, b in days} == {86400.0}
    assert stats.buckets(datetime(2024, 1, 1, 5, 30), datetime(2024, 1, 1, 6), False, "nowhere")[0][0] == datetime(2024, 1, 1, 5)


REQUEST = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]},
            "scopeSpans": [
                {
                    "spans": [
                        {
                            "traceId": "AB", "spanId": "CD", "name": "chat", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000001500000000",
                            "attributes": [{"key": "gen_ai.operation.name", "value": {"stringValue": "chat"}}, {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "12"}}, {"key": "gen_ai.usage.output_tokens", "value": {"intValue": "x"}}],
                            "status": {"code": 2}, "events": [{"name": "exception", "attributes": [{"key": "exception.type", "value": {"stringValue": "E"}}]}],
                        }
                    ]
                }
            ],
        }
    ]
}


def test_otlp_spans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(REQUEST) + "\nnot json\n")
    query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state"))
    query.awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "store" / "spans")).first()
    assert (row.trace_id, row.span_id, row.duration_ms, row.status_code, row.observation_type, row.input_tokens, row.total_tokens, row.exception_type) == ("ab", "cd", 1500, "ERROR", "generation", 12, 12, "E")
    assert (row.messages_json, row.output_preview) == ("[]", None)
    assert spark.read.parquet(str(tmp_path / "store" / "dead_letter")).count() == 1


def _attribute(key, value):
    return {"key": key, "value": {"intValue": str(value)} if isinstance(value, int) else {"stringValue": value}}


def _span(trace, span, parent, start, **attributes):
    return {"traceId": trace, "spanId": span, "parentSpanId": parent, "name": f"op {span}", "kind": 3, "startTimeUnixNano": start, "endTimeUnixNano": start, "attributes": [_attribute(k.replace("__", "."), v) for k, v in attributes.items()]}


def test_ingest_feeds_every_listing(spark, tmp_path):
    """Spans written by the ingest are read by all listings; repeated keys, bad numbers and missing ids stop nothing."""
    from spanloom.operators import feed, messages, spans as sp, stats, traces as tr
    from spanloom.sources import store

    at = "1700000000000000000"
    root = _span("aa", "01", "", at, session__id="s1", metadata='{"k": 1}', tags="x,y", gen_ai__agent__name="planner")
    call = _span("aa", "02", "01", at, gen_ai__operation__name="chat", gen_ai__request__model="model-0", gen_ai__usage__input_tokens=10, gen_ai__usage__output_tokens=5, gen_ai__request__temperature="0.5", gen_ai__response__finish_reasons='["stop"]')
    call["attributes"] += [_attribute("gen_ai.request.model", "model-1"), _attribute("gen_ai.prompt.0.role", "user"), _attribute("gen_ai.prompt.0.content", "hello there")]
    call["events"] = [{"name": "exception", "timeUnixNano": at, "attributes": [_attribute("exception.type", "E"), _attribute("exception.message", "é" * 3000), _attribute("exception.stacktrace", "at x")]}]
    call["links"] = [{"traceId": "BB", "spanId": "09", "attributes": [_attribute("why", "retry")]}]
    call["status"] = {"code": 2}
    bad = [_span("aa", "03", "01", "abc"), _span("", "04", "", at)]
    resource = {"attributes": [_attribute("deployment.environment", "prod")]}
    lines = [{"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [root, call, *bad, call]}]}]}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    prices = spark.sql("select 'model-1' price_model, 1e-3D input_cost, 2e-3D output_cost, 'chat' mode")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state"), prices=prices).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store" / "dead_letter")).count() == 3
    rows = store.read(spark, str(tmp_path / "store" / "spans"))
    assert set(store.SCHEMA) <= set(rows.columns) and rows.count() == 3

    trace = tr.list_traces(rows, project="default").collect()
    assert len(trace) == 1 and (trace[0].trace_id, trace[0].span_count, trace[0].session_id, trace[0].environment, trace[0].tags, trace[0].metadata) == ("aa", 2, "s1", "prod", ["x", "y"], '{"k": 1}')
    assert (trace[0].input_tokens, trace[0].output_tokens, trace[0].total_cost, trace[0].input_cost, trace[0].has_error, trace[0].input_preview) == (10, 5, pytest.approx(0.02), pytest.approx(0.01), True, "hello there")
    assert tr.get_trace(rows, "default", "aa").collect() == trace and tr.count_traces(rows).first().total == 1
    assert tr.list_sessions(rows).first().session_id == "s1" and tr.get_session(rows, "default", "s1").first().input_tokens == 10 and tr.count_sessions(rows).first().total == 1
    assert tr.traces_for_session(rows, "default", "s1").count() == 1
    listed = {r.span_id: r for r in sp.list_spans(rows).collect()}
    assert set(listed) == {"01", "02"} and listed["02"].gen_ai_request_model == "model-1" and listed["02"].gen_ai_finish_reasons == ["stop"] and listed["02"].gen_ai_temperature == 0.5 and listed["02"].span_kind == "CLIENT"
    assert len(listed["02"].exception_message.encode()) == 2048 and listed["02"].status_message.startswith("E: ")
    assert sp.count_spans(rows).first().total == 2 and sp.get_span(rows, "default", "aa", "02").count() == 1 and sp.spans_for_trace(rows, "default", "aa").count() == 2
    event = sp.unnested(rows.filter("span_id = '02'").limit(1), "events", sp.EVENTS).first()
    assert event.name == "exception" and event.timestamp.startswith("2023-11-14T22:13:20") and event.attributes["exception.type"] == "E"
    link = sp.unnested(rows.filter("span_id = '02'").limit(1), "links", sp.LINKS).first()
    assert (link.linked_trace_id, link.linked_span_id, link.attributes["why"]) == ("bb", "09", "retry")
    assert sorted((r.event_count, r.link_count) for r in sp.counts(rows.select(*store.KEYS).distinct(), rows).collect()) == [(0, 0), (1, 1)]
    assert sp.feed(rows, 10).count() == 2
    said = messages.get_messages(rows, "default", trace_id="aa").collect()
    assert [r.span_id for r in said] == ["02"] and json.loads(said[0].messages_json)[0]["source"] == "gen_ai.prompt.0"
    assert messages.project_messages(rows, "default", 10).count() == 1
    assert feed.leaf_errors(messages.get_messages(rows, "default", span_id="02")).first().text.endswith("\n\n```\nat x\n```")
    end = datetime(2023, 12, 1)
    assert stats.main(rows, datetime(2023, 11, 1), end).first().total_cost == pytest.approx(0.02)
    assert {r.value for r in sp.options(rows, "environment", ["trace_id"]).collect()} == {"prod"}


def test_metric_stream(spark, tmp_path):
    from spanloom.streaming.ingest import ingest_metrics

    (tmp_path / "in").mkdir()
    point = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "1700000000000000000", "asInt": "3"}]}}]}]}]}
    (tmp_path / "in" / "a.json").write_text(json.dumps(point) + "\nnot json\n")
    for _ in range(2):  # the second run finds nothing new
        ingest_metrics(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.value_int for r in spark.read.parquet(str(tmp_path / "store" / "metrics")).collect()] == [3]
    assert spark.read.parquet(str(tmp_path / "store" / "metrics_dead_letter")).count() == 1


def test_streaming_dedup(spark, tmp_path):
    tree(spark, ("a", None, "span", 1), ("a", None, "span", 1)).withColumn("timestamp_start", F.col("timestamp_start").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = deduplicated_stream(rows).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("deduped").count() == 1


def test_metrics(spark):
    point = {"timeUnixNano": "1700000000000000000"}
    request = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": [point | {"asInt": "3"}]}}, {"name": "h", "histogram": {"dataPoints": [point | {"count": "5", "sum": 2.5, "bucketCounts": ["2", "3"], "explicitBounds": [1.0]}]}}, {"name": "e", "exponentialHistogram": {"dataPoints": [point | {"count": "4", "scale": 2, "zeroCount": "1"}]}}, {"name": "q", "summary": {"dataPoints": [point | {"quantileValues": [{"quantile": 0.5, "value": 1.0}]}]}}]}]}]}
    parsed = spark.createDataFrame([(json.dumps(request),)], "v string").select(F.lit("p").alias("project_id"), F.from_json("v", otlp.METRICS_REQUEST).alias("r")).select("project_id", "r.resourceMetrics")
    rows = {r.metric_name: r for r in otlp.metrics(parsed).collect()}
    assert rows["g"].value_int == 3 and rows["h"].bucket_counts == ["2", "3"] and rows["e"].scale == 2 and rows["q"].quantiles[0].value == 1.0


def test_nested_attributes_and_exponential_histograms(spark):
    text = lambda x: {"stringValue": x}
    deep = {"arrayValue": {"values": [text("a"), {"intValue": "1"}, {"boolValue": True}, {"kvlistValue": {"values": [{"key": "k", "value": {"arrayValue": {"values": [text('"é')]}}}, {"key": "none"}]}}]}}
    attributes = [{"key": "deep", "value": deep}, {"key": "raw", "value": {"bytesValue": "AP8="}}, {"key": "empty", "value": {"arrayValue": {}}}, {"key": "s", "value": text("t")}]
    expected = {"deep": json.dumps(["a", "1", "true", json.dumps({"k": json.dumps(['"é'], ensure_ascii=False)}, ensure_ascii=False, separators=(",", ":"))], ensure_ascii=False, separators=(",", ":")), "raw": "00ff", "empty": "[]", "s": "t"}
    parse = lambda r, schema: spark.createDataFrame([(json.dumps(r),)], "v string").select(F.lit("p").alias("project_id"), F.from_json("v", schema).alias("r")).select("project_id", "r.*")
    span = {"traceId": "AB", "spanId": "CD", "name": "n", "startTimeUnixNano": "1700000000000000000", "attributes": attributes, "events": [{"name": "e", "attributes": attributes}]}
    row = otlp.spans(parse({"resourceSpans": [{"resource": {"attributes": attributes}, "scopeSpans": [{"spans": [span]}]}]}, otlp.REQUEST)).first()
    assert row.attributes == row.resource == row.events[0].attributes == expected
    exemplar = {"timeUnixNano": "1700000000000000000", "asDouble": 1.5, "traceId": "AB", "spanId": "0000000000000000", "filteredAttributes": attributes}
    point = {"timeUnixNano": "1700000000000000000", "count": "6", "scale": 2, "zeroCount": "1", "zeroThreshold": 0.25, "positive": {"offset": -3, "bucketCounts": ["2", "1"]}, "negative": {"bucketCounts": ["2"]}, "attributes": attributes, "exemplars": [exemplar]}
    row = otlp.metrics(parse({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "e", "exponentialHistogram": {"dataPoints": [point]}}]}]}]}, otlp.METRICS_REQUEST)).first()
    assert (row.zero_threshold, row.positive.asDict(), row.negative.asDict()) == (0.25, {"offset": -3, "bucket_counts": ["2", "1"]}, {"offset": 0, "bucket_counts": ["2"]})
    assert (row.exemplars[0].trace_id, row.exemplars[0].span_id, row.exemplars[0].value_double) == ("ab", None, 1.5)
    assert row.attributes == row.exemplars[0].attributes == expected


@pytest.mark.parametrize(
    ("content", "types"),
    [
        ("hello", ["text"]),
        ('[{"type":"text","text":"a"},{"type":"tool_use","id":"1","name":"f","input":{}}]', ["text", "tool_use"]),
        ('{"text":"a"}', ["text"]),
        ('[{"toolUse":{"toolUseId":"1","name":"f","input":{}}},{"toolResult":{"toolUseId":"1","content":[]}}]', ["tool_use", "tool_result"]),
        ('[{"functionCall":{"name":"f","args":{}}},{"inline_data":{"mime_type":"image/png","data":"x"}}]', ["tool_use", "image"]),
        ('{"a":1}', ["json"]),
        ('{"type":"novel"}', ["unknown"]),
        ("", []),
        ("42", ["text"]),
    ],
)
def test_content_blocks(content, types):
    assert [b["type"] for b in normalize.blocks(content)] == types


def test_normalized_and_blobs(spark):
    url = "data:image/png;base64," + "A" * 80
    df = spark.createDataFrame([(json.dumps({"text": url}),), (None,)], "c string")
    assert [len(r.b) for r in df.select(normalize.normalized(F.col("c")).alias("b")).collect()] == [1, 0]
    assert blobs.extracted(df, "c").count() == 1
    assert "blob://" in df.select(blobs.replaced(F.col("c")).alias("c")).first().c


def test_preview_and_framework(spark):
    df = spark.sql("select map('crew_key', 'x') a, array('one', ' ', repeat('y', 300)) t")
    row = df.select(classify.framework(F.col("a")).alias("f"), classify.preview(F.col("t")).alias("p")).first()
    assert (row.f, len(row.p)) == ("CrewAI", 203)
