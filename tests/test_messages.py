"""Message extraction by dialect, tool definitions, splitting, framework rules; on attributes of our own."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import classify
from spanloom.functions import messages as ms


def got(attributes, span="", events=()):
    out = ms.extract(attributes, span, list(events))
    return out["dialect"], [(m["source"], json.loads(m["content"])) for m in out["messages"]]


HELLO = {"role": "user", "content": "hi"}
CALL = {"id": "1", "name": "f", "arguments": '{"x": 1}'}


@pytest.mark.parametrize(
    ("dialect", "attributes", "expected"),
    [
        ("gen_ai_indexed", {"gen_ai.prompt.10.role": "user", "gen_ai.prompt.10.content": "b", "gen_ai.prompt.2.content": "a", "gen_ai.completion.0.role": "x"}, [("gen_ai.prompt.2", {"content": "a"}), ("gen_ai.prompt.10", {"role": "user", "content": "b"})]),
        ("otel_genai_messages", {"gen_ai.input.messages": json.dumps([HELLO]), "gen_ai.system_instructions": '[{"text": "s"}]'}, [("gen_ai.system_instructions", {"role": "system", "parts": [{"text": "s"}]}), ("gen_ai.input.messages", [HELLO])]),
        ("openinference", {"llm.input_messages.0.message.role": "user", "llm.input_messages.0.message.content": "hi", "llm.output_messages.0.message.role": "assistant"}, [("llm.input_messages.0.message", HELLO)]),
        ("openinference", {"retrieval.documents.0.document.content": "d", "retrieval.documents.0.document.score": "0.5"}, [("retrieval.documents", {"role": "documents", "content": [{"content": "d", "score": 0.5}], "_source": "retrieval.documents"})]),
        ("logfire_events", {"events": json.dumps([{"event.name": "gen_ai.user.message", "content": "hi"}, {"data": {"type": "input_text"}}, {"data": {"type": "input_image"}}, {"data": {"type": "output_text"}}])},
         [("gen_ai.user.message", {"event.name": "gen_ai.user.message", "content": "hi"}), ("gen_ai.user.message", {"role": "user", "content": [{"type": "input_text"}, {"type": "input_image"}]}), ("gen_ai.assistant.message", {"role": "assistant", "content": [{"type": "output_text"}]})]),
        ("vercel_ai", {"ai.prompt.messages": json.dumps([HELLO]), "ai.response.text": "yes", "ai.response.finishReason": "stop"}, [("ai.prompt.messages", HELLO), ("ai.response", {"finishReason": "stop", "content": "yes", "role": "assistant"})]),
        ("google_adk", {"gcp.vertex.agent.llm_request": json.dumps({"contents": [{"role": "user", "parts": [1]}], "config": {"system_instruction": "s"}}), "gcp.vertex.agent.llm_response": json.dumps({"content": {"role": "model", "parts": [2]}, "finish_reason": "STOP"})},
         [("gcp.vertex.agent.llm_request", {"role": "system", "content": "s"}), ("gcp.vertex.agent.llm_request", {"role": "user", "content": [1]}), ("gcp.vertex.agent.llm_response", {"role": "assistant", "content": [2], "finish_reason": "stop"})]),
        ("livekit", {"lk.user_input": "hi", "lk.response.text": "yes"}, [("lk.user_input", HELLO), ("lk.response.text", {"role": "assistant", "content": "yes"})]),
        ("mlflow", {"mlflow.spanInputs": json.dumps(HELLO)}, [("mlflow.spanInputs", HELLO)]),
        ("mlflow", {"mlflow.chat.tools": "[]"}, []),
        ("traceloop", {"traceloop.entity.output": '{"a": 1}'}, [("traceloop.entity.output", {"a": 1})]),
        ("pydantic_ai", {"tool_arguments": "not json"}, [("tool_arguments", {"role": "tool_call", "content": "not json"})]),
        ("langsmith", {"langsmith.trace.name": "t", "gen_ai.prompt": json.dumps({"messages": [HELLO, {"role": "user"}]}), "gen_ai.completion": json.dumps({"choices": [{"message": {"role": "assistant"}, "finish_reason": "stop"}]})}, [("gen_ai.prompt", HELLO), ("gen_ai.completion", {"role": "assistant", "finish_reason": "stop"})]),
        ("langgraph", {"langgraph.node": "n", "input.value": json.dumps({"messages": [{"type": "human", "content": "hi"}, {"lc": 1, "kwargs": {"type": "tool", "content": "r", "tool_call_id": "1"}}]})}, [("input.value", HELLO), ("input.value", {"role": "tool", "content": "r", "tool_call_id": "1"})]),
        ("autogen", {"message": json.dumps({"type": "TextMessage", "source": "user", "content": "hi"})}, [("message", HELLO)]),
        ("autogen", {"message": json.dumps({"messages": [{"type": "ToolCallRequestEvent", "source": "bot", "content": [CALL]}]})}, [("message", {"role": "assistant", "name": "bot", "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": {"x": 1}}}]})]),
        ("autogen", {"input.value": '{"cancellation_token": 1}'}, []),  # claimed without messages: raw input is not read
        ("crewai", {"crew_key": "k", "output.value": json.dumps({"tasks_output": [{"messages": [HELLO, {"role": "user"}]}]})}, [("output.value", HELLO)]),
        ("raw_io", {"input.value": '{"a": 1}', "response": json.dumps(HELLO)}, [("input.value", {"role": "user", "content": {"a": 1}}), ("response", HELLO)]),
        (None, {"input.value": "plain text"}, []),
        (None, {}, []),
        (None, {"gen_ai.operation.name": "execute_tool", "input.value": '{"a": 1}'}, []),
    ],
)
def test_dialects(dialect, attributes, expected):
    assert got(attributes) == (dialect, expected)


def test_events_end_the_search():
    event = {"name": "gen_ai.choice", "attributes": {"message": '{"a": 1}', "id": "7"}}
    assert got({"input.value": '{"a": 1}'}, events=[event, {"name": "other", "attributes": {}}]) == (None, [("gen_ai.choice", {"message": {"a": 1}, "id": "7"})])
    tool = {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.name": "f", "gen_ai.tool.call.id": "9"}
    assert got(tool, events=[{"name": "gen_ai.tool.message", "attributes": {"content": "x"}}])[1] == [("gen_ai.tool.message", {"tool_call_id": "9", "role": "tool_call", "name": "f", "content": "x"})]


def test_system_prompt_does_not_end_the_search():
    assert [s for s, _ in got({"system_prompt": "s", "mlflow.spanInputs": "[1]"})[1]] == ["system_prompt", "mlflow.spanInputs"]


@pytest.mark.parametrize(
    "tool",
    [
        {"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object"}}},
        {"name": "f", "description": "d", "input_schema": {"type": "object"}},
        {"toolSpec": {"name": "f", "description": "d", "inputSchema": {"json": {"type": "object"}}}},
        {"functionDeclarations": [{"name": "f", "description": "d", "parameters": {"type": "object"}}]},
    ],
)
def test_tool_forms(tool):
    assert ms.normalized_tool(tool) == [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object"}}}]
    assert [y for x in ms.normalized_tool(tool) for y in ms.normalized_tool(x)] == ms.normalized_tool(tool)


def test_tool_definitions():
    tools, names = ms.tool_definitions({"llm.tools.0.tool.json_schema": '{"function": {"name": "f"}}', "gen_ai.tool.name": "(merged)", "gen_ai.agent.tools": '["g"]'})
    assert tools == [[{"function": {"name": "f"}}]] and names == [["g"], ["f"]]
    assert ms.tool_definitions({"tool.name": "f", "tool.parameters": "bad"})[0] == [[{"type": "function", "function": {"name": "f"}}]]


@pytest.mark.parametrize(
    ("source", "content", "n"),
    [("request_data", {"system": "s", "messages": [HELLO, HELLO, 1]}, 3), ("response_data", {"message": HELLO}, 1), ("gen_ai.input.messages", [1, 2], 1), ("x", [HELLO, HELLO], 1), ("x", {"role": "tool", "content": [{"toolResult": {}}, {"toolResult": {}}]}, 2), ("request_data", None, 1)],
)
def test_expanded(source, content, n):
    assert len(ms.expanded(source, content)) == n


def test_malformed_spans_stop_nothing(spark):
    rows = spark.sql("""select * from values (map('gcp.vertex.agent.llm_request', '{"contents": 5}'), 'a'), (null, null), (map('tool_response', 'x'), 'b') as t(a, n)""")
    out = rows.select(ms.extracted(F.col("a"), F.col("n"), F.array().cast("array<struct<name: string, attributes: map<string, string>>>")).alias("x")).collect()
    assert sorted(str(r.x.dialect) for r in out) == ["None", "malformed", "pydantic_ai"]


@pytest.mark.parametrize(
    ("framework", "attributes", "resource", "name"),
    [
        ("AutoGen", {"gen_ai.system": "autogen"}, {"service.name": "strands-agents"}, "x"),
        ("LangGraph", {"metadata": '{"langgraph_node": 1}', "langchain.x": "1"}, {}, "x"),
        ("VertexAI", {}, {}, "vertexai.generate"),
        ("Logfire", {}, {"telemetry.sdk.name": "logfire"}, "x"),
        ("StrandsAgents", {}, {"service.name": "strands-agents"}, "x"),
        ("StrandsAgents", {"gen_ai.agent.name": "My Strands Agent"}, {}, "x"),
        ("AWSBedrock", {"gen_ai.system": "aws.bedrock"}, {}, "x"),
        ("Unknown", {"x": "1"}, {}, "x"),
    ],
)
def test_frameworks(spark, framework, attributes, resource, name):
    row = spark.createDataFrame([(attributes, resource, name)], "a map<string,string>, r map<string,string>, n string")
    assert row.select(classify.framework(F.col("a"), F.col("n"), F.col("r"))).first()[0] == framework


@pytest.mark.parametrize(
    ("attributes", "name", "category", "kind"),
    [
        ({"rpc.system": "aws-api", "gen_ai.operation.name": "chat"}, "x", "http", "span"),
        ({"gen_ai.operation.name": "text_completion", "gen_ai.request.model": "titan-Embed"}, "x", "embedding", "embedding"),
        ({"openinference.span.kind": "chain"}, "x", "chain", "chain"),
        ({"langsmith.span.kind": "LLM"}, "x", "other", "generation"),
        ({"ai.model.id": "m", "ai.operationId": "ai.embed"}, "x", "other", "embedding"),
        ({}, "my agent", "other", "agent"),
        ({"gen_ai.request.model": "m"}, "x", "other", "generation"),
        ({}, "chat", "llm", "span"),
    ],
)
def test_classes(spark, attributes, name, category, kind):
    row = spark.createDataFrame([(attributes, name)], "a map<string,string>, n string").select(classify.category(F.col("a"), F.col("n")), classify.observation_type(F.col("a"), F.col("n"))).first()
    assert tuple(row) == (category, kind)


def test_merged_tools():
    full = {"type": "function", "function": {"name": "f", "description": "n/a", "parameters": {"properties": {"a": {"type": "string"}}, "required": ["a"]}}}
    bare = {"type": "function", "function": {"name": "f", "description": "does", "parameters": {"properties": {"b": {}}, "required": ["b"]}}, "strict": True}
    expected = {"type": "function", "strict": True, "function": {"name": "f", "description": "does", "parameters": {"properties": {"a": {"type": "string"}, "b": {}}, "required": ["b", "a"]}}}  # of equal completeness the lesser text is the base
    assert ms.merged_tool([full, bare]) == ms.merged_tool([bare, full]) == expected


@pytest.mark.parametrize(
    ("system", "model", "confidence"),
    [
        (None, "GPT-4", 1.0), (None, "us.gpt-4", 1.0), (None, "any/gpt-4", 0.95), (None, "openai:gpt-4", 1.0), (None, "projects/p/models/gpt-4", 1.0), (None, "ft:gpt-4:org::id", 0.85), (None, "ft:gpt-4-20240101:org", 0.70),
        (None, "gpt-4:free", 0.85), (None, "gpt-4@20240101", 0.85), (None, "gpt-4-v1:0", 0.85), (None, "gpt-4-2024-01-01", 0.70), ("AWS_Bedrock", "nova", 0.95), (None, "nova", 0.0), ("langchain", "nova", 0.0), (None, None, 0.0), (None, "a/b:0123456789abcdef", 1.0),
    ],
)
def test_price_names(spark, system, model, confidence):
    from spanloom.functions import pricing

    prices = spark.sql("select * from values ('gpt-4', 1D, 1D, 'chat'), ('bedrock/nova', 1D, 1D, 'chat'), ('a/b', 1D, 1D, 'chat') as t(price_model, input_cost, output_cost, mode)")
    rows = spark.createDataFrame([(system, model, 1, 0)], "system string, model string, input_tokens long, output_tokens long")
    assert pricing.priced(rows, prices).first().confidence == confidence


def test_price_parts(spark):
    from spanloom.functions import pricing

    prices = spark.sql("select 'm' price_model, 1D input_cost, 2D output_cost, 'chat' mode, true supports_caching, 0.5D cache_read_cost union all select 'e', 1D, 2D, 'embedding', false, 0D")
    columns = "system string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long"
    rows = spark.createDataFrame([(None, "m", 1, 1, 2, 3, 4), (None, "e", 1, 9, 0, 3, 9), (None, "m", -5, None, 0, 0, 0)], columns)
    assert sorted(float(r.cost_total) for r in pricing.priced(rows, prices).collect()) == [0.0, 1.0, 1 + 2 + 1 + 3 + 8]


@pytest.mark.parametrize(
    ("attributes", "expected"),
    [
        ({"gen_ai.input.messages": json.dumps([{"role": "system", "content": "s"}, HELLO, {"role": "user", "parts": [{"text": " last "}]}]), "gen_ai.output.messages": json.dumps([{"role": "assistant", "content": "x" * 201}])}, ("last", "x" * 200 + "...")),
        ({"system_prompt": "s", "tool_response": "done"}, ("s", "done")),
        ({"input.value": "5"}, (None, None)),
        ({}, (None, None)),
    ],
)
def test_previews(attributes, expected):
    out = ms.extract(attributes, "", [])
    assert (out["input_preview"], out["output_preview"]) == expected
