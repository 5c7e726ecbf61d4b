"""Flattening of OTLP requests: resources, scopes, spans; metrics, one row for each data point."""

from __future__ import annotations

import base64
import json
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrays and maps nest without end, so they are read as their JSON text.
VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, arrayValue: string, kvlistValue: string, bytesValue: string>"
ATTRIBUTES = f"array<struct<key: string, value: {VALUE}>>"
EVENT = f"struct<name: string, timeUnixNano: string, attributes: {ATTRIBUTES}>"
LINK = f"struct<traceId: string, spanId: string, traceState: string, attributes: {ATTRIBUTES}>"
SPAN = f"struct<traceId: string, spanId: string, parentSpanId: string, traceState: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {ATTRIBUTES}, events: array<{EVENT}>, links: array<{LINK}>, status: struct<code: int, message: string>>"
#: Kinds of spans by their number.
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
REQUEST = f"resourceSpans array<struct<resource: struct<attributes: {ATTRIBUTES}>, scopeSpans: array<struct<scope: struct<name: string>, spans: array<{SPAN}>>>>>"
BUCKETS = "struct<offset: int, bucketCounts: array<string>>"
EXEMPLAR = f"struct<timeUnixNano: string, asInt: string, asDouble: double, traceId: string, spanId: string, filteredAttributes: {ATTRIBUTES}>"
POINT = f"struct<timeUnixNano: string, asInt: string, asDouble: double, count: string, sum: double, min: double, max: double, bucketCounts: array<string>, explicitBounds: array<double>, scale: int, zeroCount: string, zeroThreshold: double, positive: {BUCKETS}, negative: {BUCKETS}, exemplars: array<{EXEMPLAR}>, quantileValues: array<struct<quantile: double, value: double>>, attributes: {ATTRIBUTES}>"
_KIND = f"struct<dataPoints: array<{POINT}>, aggregationTemporality: int, isMonotonic: boolean>"
METRIC = f"struct<name: string, unit: string, gauge: {_KIND}, sum: {_KIND}, histogram: {_KIND}, exponentialHistogram: {_KIND}, summary: {_KIND}>"
METRICS_REQUEST = f"resourceMetrics array<struct<resource: struct<attributes: {ATTRIBUTES}>, scopeMetrics: array<struct<scope: struct<name: string>, metrics: array<{METRIC}>>>>>"


def plain_text(value: object) -> str:
    """Text of a value of the wire: of arrays and maps JSON, with the texts of what they hold."""
    if not isinstance(value, dict):
        return ""
    kind, v = next(((k, v) for k, v in value.items() if k.endswith("Value") and v is not None), ("", None))
    if kind == "arrayValue":
        return json.dumps([plain_text(x) for x in v.get("values") or []], ensure_ascii=False, separators=(",", ":"))
    if kind == "kvlistValue":
        held = {x.get("key", ""): plain_text(x["value"]) for x in v.get("values") or [] if x.get("value") is not None}
        return json.dumps(held, ensure_ascii=False, separators=(",", ":"))
    if kind == "boolValue":
        return "true" if v else "false"
    if kind == "bytesValue":
        return base64.b64decode(v).hex()
    if kind == "doubleValue" and isinstance(v, float):
        return format(Decimal(repr(v)), "f").removesuffix(".0")
    return str(v) if kind else ""


def _plain_texts(wire: Column) -> Column:
    def text(x: str) -> str:
        try:
            return plain_text(json.loads(x))
        except (ValueError, TypeError, AttributeError, KeyError, RecursionError):
            return x  # not of the wire's form: kept as it is

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        if not column.null_count and not len(column.flatten()):
            return column  # nothing nested in the whole batch, as in most
        return pa.array([[text(x) for x in xs or []] for xs in column.to_pylist()], pa.list_(pa.string()))

    return run(wire)


def _wire(value: Column) -> Column:
    """An array or map as the wire has it; null for other values."""
    form = lambda kind: F.when(value[kind].isNotNull(), F.concat(F.lit(f'{{"{kind}":'), value[kind], F.lit("}")))
    return F.coalesce(form("arrayValue"), form("kvlistValue"))


def nested_texts(*attributes: Column) -> Column:
    """Wire form to text, of the arrays and maps in these attributes: only they leave the JVM."""
    none = F.array().cast(ATTRIBUTES)
    every = F.concat(*[F.transform(F.coalesce(a, none), lambda e: _wire(e["value"])) for a in attributes])
    wire = F.array_distinct(F.array_compact(every))
    return F.map_from_arrays(wire, _plain_texts(wire))


def attribute_map(attributes: Column, nested: Column) -> Column:
    """Key to string; of equal keys the last wins.  ``nested``: ``nested_texts`` of them."""
    raw = lambda v: F.lower(F.hex(F.try_to_binary(v["bytesValue"], F.lit("base64"))))
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), F.try_element_at(nested, _wire(v)), raw(v))
    entries = F.coalesce(attributes, F.array().cast(ATTRIBUTES))
    named = F.filter(entries, lambda e: e["key"].isNotNull())
    keys = F.transform(named, lambda e: e["key"])
    once = F.array_distinct(keys)
    # repeated keys are rare; only then is each key's last entry searched
    last = F.transform(once, lambda k: text(F.element_at(F.filter(named, lambda e: e["key"] == k), -1)["value"]))
    values = F.when(F.size(once) == F.size(keys), F.transform(named, lambda e: text(e["value"]))).otherwise(last)
    return F.map_from_arrays(once, values)


def nanos(text: Column) -> Column:
    """Null for a text that is no number."""
    return F.timestamp_micros((text.try_cast("decimal(20,0)") / 1000).cast("long"))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each, so that no later expression computes a column of them again.

    The columns pass beside the generator, so those that nobody reads are not computed at all.
    """
    return rows.withColumn("_one", F.explode(F.array(F.lit(1)))).drop("_one")


def spans(requests: DataFrame) -> DataFrame:
    """A row for each span of each request (column ``resourceSpans``, with project_id)."""
    # out of a generator: the optimizer tests what is exploded for null and size, and would parse the request again for each test
    parsed = requests.select("project_id", F.explode(F.array("resourceSpans")).alias("resourceSpans"))
    r = parsed.select("project_id", F.explode("resourceSpans").alias("r")).withColumn("nested", nested_texts(F.col("r.resource.attributes")))
    s = r.select("project_id", attribute_map(F.col("r.resource.attributes"), F.col("nested")).alias("resource"), F.explode("r.scopeSpans").alias("s"))
    x = s.select("project_id", "resource", F.explode("s.spans").alias("x"))
    events = F.coalesce("x.events", F.array().cast(f"array<{EVENT}>"))
    said = F.flatten(F.transform(events, lambda e: F.coalesce(e["attributes"], F.array().cast(ATTRIBUTES))))
    linked = F.flatten(F.transform(F.coalesce("x.links", F.array().cast(f"array<{LINK}>")), lambda k: F.coalesce(k["attributes"], F.array().cast(ATTRIBUTES))))
    x = x.withColumn("nested", nested_texts(F.col("x.attributes"), said, linked))
    nested = F.col("nested")
    start, end = F.col("x.startTimeUnixNano"), F.nullif(F.col("x.endTimeUnixNano"), F.lit("0"))
    return settled(x.select(
        "project_id", F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.nullif(F.lower("x.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("x.name").alias("span_name"),
        F.nullif("x.traceState", F.lit("")).alias("trace_state"), F.coalesce(F.get(F.array(*map(F.lit, KINDS)), F.col("x.kind")), F.lit("UNSPECIFIED")).alias("span_kind"), F.col("x.status.message").alias("status_message"),
        nanos(start).alias("timestamp_start"), nanos(end).alias("timestamp_end"),
        F.coalesce(F.expr("(try_cast(nullif(x.endTimeUnixNano, '0') as bigint) - try_cast(x.startTimeUnixNano as bigint)) div 1000000"), F.lit(0)).alias("duration_ms"),
        F.when(F.col("x.status.code") == 2, "ERROR").when(F.col("x.status.code") == 1, "OK").otherwise("UNSET").alias("status_code"),
        "resource", attribute_map(F.col("x.attributes"), nested).alias("attributes"),
        F.transform(events, lambda e: F.struct(e["name"].alias("name"), nanos(e["timeUnixNano"]).alias("timestamp"), attribute_map(e["attributes"], nested).alias("attributes"))).alias("events"),
        F.transform(F.coalesce("x.links", F.array().cast(f"array<{LINK}>")), lambda k: F.struct(F.lower(k["traceId"]).alias("trace_id"), F.lower(k["spanId"]).alias("span_id"), k["traceState"].alias("trace_state"), attribute_map(k["attributes"], nested).alias("attributes"))).alias("links"),
    ))


def metrics(requests: DataFrame) -> DataFrame:
    """A row for each data point of gauges, sums, histograms, exponential histograms and summaries."""
    r = requests.select("project_id", F.explode("resourceMetrics").alias("r")).select("project_id", F.explode("r.scopeMetrics").alias("s")).select("project_id", F.explode("s.metrics").alias("m"))
    # all kinds of points in one array: the request is parsed once, not once for each kind
    def tagged(kind: str, name: str) -> Column:
        points = F.coalesce(f"m.{kind}.dataPoints", F.array().cast(f"array<{POINT}>"))
        about = [F.lit(name).alias("type"), F.col(f"m.{kind}.aggregationTemporality").alias("temporality"), F.col(f"m.{kind}.isMonotonic").alias("is_monotonic")]
        return F.transform(points, lambda p: F.struct(*about, p.alias("p")))

    kinds = {"gauge": "gauge", "sum": "sum", "histogram": "histogram", "exponentialHistogram": "exponential_histogram", "summary": "summary"}
    points = F.concat(*[tagged(kind, name) for kind, name in kinds.items()])
    rows = r.select("project_id", F.col("m.name").alias("metric_name"), F.explode(points).alias("x")).select("project_id", "metric_name", F.col("x.type").alias("metric_type"), "x.temporality", "x.is_monotonic", "x.p")
    exemplars = F.coalesce("p.exemplars", F.array().cast(f"array<{EXEMPLAR}>"))
    about = F.flatten(F.transform(exemplars, lambda e: F.coalesce(e["filteredAttributes"], F.array().cast(ATTRIBUTES))))
    rows = rows.withColumn("nested", nested_texts(F.col("p.attributes"), about))
    nested = F.col("nested")
    known = lambda i: F.when(i.rlike("[^0]"), F.lower(i))
    exemplar = lambda e: F.struct(
        known(e["traceId"]).alias("trace_id"), known(e["spanId"]).alias("span_id"), e["asInt"].try_cast("long").alias("value_int"), e["asDouble"].alias("value_double"),
        nanos(F.nullif(e["timeUnixNano"], F.lit("0"))).alias("timestamp"), attribute_map(e["filteredAttributes"], nested).alias("attributes"),
    )
    buckets = lambda b: F.when(b.isNotNull(), F.struct(F.coalesce(b["offset"], F.lit(0)).alias("offset"), F.coalesce(b["bucketCounts"], F.array().cast("array<string>")).alias("bucket_counts")))
    return rows.select(
        "project_id", "metric_name", "metric_type", "temporality", "is_monotonic", nanos(F.col("p.timeUnixNano")).alias("timestamp"), F.col("p.asInt").try_cast("long").alias("value_int"), F.col("p.asDouble").alias("value_double"),
        F.col("p.count").try_cast("decimal(20,0)").alias("count"), F.col("p.sum").alias("sum"), F.col("p.min").alias("min"), F.col("p.max").alias("max"), F.col("p.bucketCounts").alias("bucket_counts"), F.col("p.explicitBounds").alias("bounds"),
        F.col("p.scale").alias("scale"), F.col("p.zeroCount").try_cast("decimal(20,0)").alias("zero_count"), F.when(F.col("metric_type") == "exponential_histogram", F.coalesce("p.zeroThreshold", F.lit(0.0))).alias("zero_threshold"), buckets(F.col("p.positive")).alias("positive"), buckets(F.col("p.negative")).alias("negative"),
        F.col("p.quantileValues").alias("quantiles"), F.transform(exemplars, exemplar).alias("exemplars"), attribute_map(F.col("p.attributes"), nested).alias("attributes"),
    )


def enriched(rows: DataFrame) -> DataFrame:
    """Spans with every column of the span table that attributes, events and resource give."""
    from . import classify as c

    rows = rows.withColumn("_name", F.col("span_name"))
    a, name, raw = F.col("attributes"), F.col("span_name"), F.col("_name")
    status, message = (F.col(x) if x in rows.columns else F.lit(None).cast("string") for x in ("status_code", "status_message"))
    rows = rows.withColumn("span_name", c.display_name(a, raw))
    found = {"framework": c.framework(a, raw, F.col("resource")), "span_category": c.category(a, raw), "observation_type": c.observation_type(a, raw), "session_id": c.session_id(a), "user_id": c.user_id(a)}
    return settled(rows.withColumns(found | c.tokens(a) | c.stored_fields(a, raw, F.col("events"), F.col("resource"), status, message)).drop("_name"))


def with_messages(rows: DataFrame) -> DataFrame:
    """Raw messages, tool definitions and previews of each span.  Only here does a whole row leave the JVM, once."""
    from . import messages as m

    found = rows.withColumn("_found", m.extracted(F.col("attributes"), F.col("span_name"), F.col("events")))
    return found.withColumns({c: F.col(f"_found.{c}") for c in ("dialect", "messages", "tools", "tool_names", "input_preview", "output_preview")}).drop("_found")


def with_costs(rows: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Costs by the price of the response's model, else the request's; where that gives none, those the span itself reports."""
    from . import classify as c
    from .pricing import PARTS, priced

    a = F.col("attributes")
    told = lambda key: F.coalesce(c.get(a, key).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    reported = {"cost_total": told("llm.cost.total"), "cost_input": told("llm.cost.prompt"), "cost_output": told("llm.cost.completion")}
    reported |= {x: F.lit(0).cast("decimal(18,6)") for x in PARTS if x not in reported}
    reported = {x: F.when(c.get(a, "llm.cost.total").try_cast("double").isNotNull(), v).otherwise(F.lit(0).cast("decimal(18,6)")) for x, v in reported.items()}
    if prices is None:
        return rows.withColumns(reported)
    asked = rows.withColumns({"system": F.col("gen_ai_system"), "model": F.coalesce("gen_ai_response_model", "gen_ai_request_model")})
    out = priced(asked, prices).drop("system", "model", "confidence")
    return out.withColumns({x: F.when(F.col("cost_total") > 0, F.col(x)).otherwise(v) for x, v in reported.items()})


def stored(rows: DataFrame) -> DataFrame:
    """Rows of the span table: nested columns as JSON, only the columns of its schema."""
    from ..sources.store import SCHEMA, conformed

    as_json = {"messages_json": "messages", "tool_definitions_json": "tools", "tool_names_json": "tool_names", "attributes_json": "attributes", "resource_attributes": "resource"}
    texts = {to: F.to_json(of) for to, of in as_json.items() if of in rows.columns}
    texts |= {x: F.to_json(x, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}) for x in ("events", "links")}
    raw = F.to_json(F.struct("trace_id", "span_id", "parent_span_id", F.col("span_name").alias("name"), "attributes", F.struct(F.col("resource").alias("attributes")).alias("resource")))
    return conformed(rows.withColumns(texts | {"raw_span": raw})).select(*SCHEMA)
