"""Classification and extraction of span attributes (a map of strings), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frameworks and what shows them, in order; the first that holds wins.  "name" and "prefix" are
#: beginnings of the span name and of attribute keys, "key" an attribute, "is" its value, "service" the service
#: name, "metadata" and "sdk" parts of the metadata and of the SDK's name.
FRAMEWORKS: tuple[tuple[str, dict], ...] = (
    ("AutoGen", {"name": ("autogen ", "autogen."), "prefix": ("autogen.",), "is": (("gen_ai.system", "autogen"),)}),
    ("GoogleADK", {"prefix": ("google.adk.", "gcp.vertex.agent."), "is": (("gen_ai.system", "gcp.vertex.agent"),)}),
    ("CrewAI", {"service": ("crewAI-telemetry",), "key": ("crewai_version", "crew_key", "crew_id", "crew_fingerprint", "task_key")}),
    ("LangGraph", {"name": ("LangGraph",), "prefix": ("langgraph.",), "metadata": ("langgraph_",)}),
    ("LangChain", {"prefix": ("langchain.", "langsmith.")}),
    ("LlamaIndex", {"prefix": ("llama_index.",)}),
    ("OpenInference", {"prefix": ("openinference.",)}),
    ("SemanticKernel", {"prefix": ("semantic_kernel.",)}),
    ("AzureOpenAI", {"is": (("gen_ai.system", "azure_openai"), ("gen_ai.system", "azure.openai"), ("gen_ai.provider.name", "azure_openai")), "prefix": ("azure.openai.",)}),
    ("AzureAIFoundry", {"prefix": ("az.ai.",)}),
    ("VertexAI", {"name": ("vertexai.",)}),
    ("VercelAISDK", {"key": ("ai.operationId", "ai.telemetry.functionId", "ai.telemetry.metadata"), "prefix": ("ai.prompt.", "ai.completion.", "ai.settings.", "ai.telemetry.", "ai.stream.", "ai.finishReason", "ai.usage.")}),
    ("Logfire", {"prefix": ("logfire.",), "sdk": ("logfire",)}),
    ("MLflow", {"prefix": ("mlflow.",)}),
    ("TraceLoop", {"prefix": ("traceloop.",), "sdk": ("traceloop",)}),
    ("LiveKit", {"prefix": ("livekit.", "lk.")}),
    ("OpenAIAgents", {"prefix": ("openai.agents.",), "service": ("openai-agents", "openai_agents")}),
    ("AgentFramework", {"is": (("gen_ai.provider.name", "microsoft.agent_framework"),), "service": ("agent-framework-core",)}),
    ("AWSBedrock", {"prefix": ("aws.bedrock.",), "is": (("gen_ai.system", "aws_bedrock"), ("gen_ai.system", "aws.bedrock"))}),
    ("StrandsAgents", {"is": (("gen_ai.system", "strands-agents"), ("gen_ai.provider.name", "strands-agents")), "service": ("strands-agents",), "agent": "strands[ _-]agent"}),
)
#: Declared kinds of spans: (category, observation type).
KINDS = {"LLM": ("llm", "generation"), "EMBEDDING": ("embedding", "embedding"), "AGENT": ("agent", "agent"), "TOOL": ("tool", "tool"), "CHAIN": ("chain", "chain"), "RETRIEVER": ("retriever", "retriever"), "GUARDRAIL": ("other", "guardrail"), "EVALUATOR": ("other", "evaluator")}
#: Parts of span names and the observation types they give, in order.
NAMES = (("embed", "embedding"), ("agent", "agent"), ("tool", "tool"), ("retriev", "retriever"), ("guardrail", "guardrail"), ("eval", "evaluator"))
SESSION_KEYS = ("session.id", "langsmith.session.id", "langsmith.trace.session_id", "gcp.vertex.agent.session_id", "ai.telemetry.metadata.sessionId", "langgraph.thread_id", "mlflow.trace.session")
USER_KEYS = ("user.id", "enduser.id", "ai.telemetry.metadata.userId", "mlflow.trace.user")
INPUT_TOKENS = ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.usage.prompt_tokens", "llm.token_count.prompt", "ai.usage.promptTokens")
OUTPUT_TOKENS = ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.usage.completion_tokens", "llm.token_count.completion", "ai.usage.completionTokens")
TOTAL_TOKENS = ("gen_ai.usage.total_tokens", "llm.token_count.total")
CACHE_READ_TOKENS = ("gen_ai.usage.cache_read_input_tokens", "gen_ai.usage.cache_read_tokens", "llm.usage.cache_read_input_tokens", "ai.usage.cachedInputTokens")
CACHE_WRITE_TOKENS = ("gen_ai.usage.cache_creation_input_tokens", "gen_ai.usage.cache_write_input_tokens", "gen_ai.usage.cache_write_tokens", "llm.usage.cache_creation_input_tokens")
REASONING_TOKENS = ("gen_ai.usage.output_reasoning_tokens", "gen_ai.usage.thoughts_token_count", "ai.usage.reasoningTokens")


def get(a: Column, *keys: str) -> Column:
    """The first key that is present."""
    return F.coalesce(*[F.try_element_at(a, F.lit(k)) for k in keys])


def has_prefix(a: Column, prefix: str) -> Column:
    return F.exists(F.map_keys(a), lambda k: k.startswith(prefix))


def _or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def framework(a: Column, name: Column | None = None, resource: Column | None = None) -> Column:
    """The first rule that holds; ``resource`` are the attributes of the resource."""
    name = F.lit("") if name is None else name
    resource = F.create_map().cast("map<string,string>") if resource is None else resource
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    out = F.when(F.lit(False), "")
    for label, rule in FRAMEWORKS:
        holds = [name.startswith(x) for x in rule.get("name", ())] + [has_prefix(a, x) for x in rule.get("prefix", ())]
        holds += [of(a, k).isNotNull() for k in rule.get("key", ())] + [of(a, k) == v for k, v in rule.get("is", ())]
        holds += [of(resource, "service.name") == x for x in rule.get("service", ())] + [of(resource, "telemetry.sdk.name").contains(x) for x in rule.get("sdk", ())]
        holds += [of(a, "metadata").contains(x) for x in rule.get("metadata", ())]
        if "agent" in rule:
            holds += [F.lower(x).rlike(rule["agent"]) for x in (name, of(a, "gen_ai.agent.name"))]
        out = out.when(_or(holds), label)
    return out.otherwise("Unknown")


def _kind(a: Column, which: int, *keys: str) -> Column:
    kinds = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[which])])
    return F.coalesce(*[F.try_element_at(kinds, F.upper(get(a, k))) for k in keys])


def _embeds(a: Column) -> Column:
    return F.coalesce(F.lower(get(a, "gen_ai.request.model", "gen_ai.response.model")).contains("embed"), F.lit(False))


def category(a: Column, name: Column) -> Column:
    """Calls of other services first, whatever else the span says; then operation, tool or agent, declared kind, name."""
    operation, low = get(a, "gen_ai.operation.name"), F.lower(name)
    chat = operation.isin("chat", "text_completion")
    kind = _kind(a, 0, "openinference.span.kind")
    return (
        F.when(get(a, "http.method", "http.request.method", "rpc.system").isNotNull(), "http")
        .when(get(a, "db.system").isNotNull(), "db")
        .when(get(a, "messaging.system").isNotNull(), "messaging")
        .when(has_prefix(a, "aws.s3."), "storage")
        .when(chat & _embeds(a), "embedding")
        .when(chat, "llm")
        .when(operation == "embeddings", "embedding")
        .when(operation == "execute_tool", "tool")
        .when(operation.isin("invoke_agent", "invoke_swarm", "execute_event_loop_cycle"), "agent")
        .when(get(a, "gen_ai.tool.name").isNotNull(), "tool")
        .when(get(a, "gen_ai.agent.name").isNotNull(), "agent")
        .when(kind.isNotNull(), kind)
        .when(low.contains("llm") | low.contains("chat"), "llm")
        .when(low.contains("embed"), "embedding")
        .when(low.contains("retriev"), "retriever")
        .otherwise("other")
    )


def observation_type(a: Column, name: Column) -> Column:
    operation, low = get(a, "gen_ai.operation.name"), F.lower(name)
    chat = operation.isin("chat", "text_completion")
    kind = _kind(a, 1, "openinference.span.kind", "langsmith.span.kind")
    out = (
        F.when(get(a, "http.method", "http.request.method", "rpc.system", "db.system").isNotNull(), "span")
        .when(chat & _embeds(a), "embedding")
        .when(chat, "generation")
        .when(operation == "embeddings", "embedding")
        .when((operation == "create_agent") & (get(a, "gen_ai.system") == "autogen"), "span")
        .when(kind.isNotNull(), kind)
        .when(get(a, "ai.model.id", "ai.model.provider").isNotNull(), F.when(get(a, "ai.operationId").contains("embed"), "embedding").otherwise("generation"))
        .when(get(a, "gen_ai.agent.name", "gen_ai.agent.id").isNotNull(), "agent")
        .when(get(a, "gen_ai.tool.name", "gen_ai.tool.call.id").isNotNull(), "tool")
    )
    for part, what in NAMES:
        out = out.when(low.contains(part), what)
    return out.when(F.lower(get(a, "logfire.tags")).contains("llm") | get(a, "gen_ai.request.model", "gen_ai.response.model").isNotNull(), "generation").otherwise("span")


def session_id(a: Column) -> Column:
    m = get(a, "metadata")
    return F.coalesce(get(a, *SESSION_KEYS), F.get_json_object(m, "$.thread_id"), F.get_json_object(m, "$.langgraph_thread_id"))


def user_id(a: Column) -> Column:
    return F.coalesce(get(a, *USER_KEYS), F.get_json_object(get(a, "metadata"), "$.user_id"))


def tokens(a: Column) -> dict[str, Column]:
    """The first present key decides; if it is no number, the count is 0."""
    count = lambda keys: F.coalesce(get(a, *keys).try_cast("long"), F.lit(0).cast("long"))
    one, two = count(INPUT_TOKENS), count(OUTPUT_TOKENS)
    more = {"cache_read_tokens": count(CACHE_READ_TOKENS), "cache_write_tokens": count(CACHE_WRITE_TOKENS), "reasoning_tokens": count(REASONING_TOKENS)}
    return {"input_tokens": one, "output_tokens": two, "total_tokens": F.greatest(count(TOTAL_TOKENS), one + two)} | more


def usage_details(a: Column) -> Column:
    known = [*INPUT_TOKENS, *OUTPUT_TOKENS, *TOTAL_TOKENS, *CACHE_READ_TOKENS, *CACHE_WRITE_TOKENS, *REASONING_TOKENS]
    return F.to_json(F.map_filter(a, lambda k, v: k.startswith("gen_ai.usage.") & ~k.isin(known)))


def tags(*lists: Column) -> Column:
    """Union in order, each once; a list is JSON or separated by commas."""
    parse = lambda c: F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.transform(F.split(c, ","), lambda x: F.trim(x))), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(*map(parse, lists)), lambda x: F.length(x) > 0))


def exception_fields(events: Column) -> dict[str, Column]:
    """Type and message of the first exception event (an array of name and attributes)."""
    first = F.get(F.filter(events, lambda e: e["name"] == "exception"), 0)["attributes"]
    return {"exception_type": F.try_element_at(first, F.lit("exception.type")), "exception_message": F.try_element_at(first, F.lit("exception.message"))}


def preview(texts: Column, chars: int = 200) -> Column:
    """The last non-empty text, trimmed and cut."""
    last = F.trim(F.element_at(F.filter(texts, lambda x: F.length(F.trim(x)) > 0), -1))
    return F.when(F.length(last) > chars, F.concat(F.substring(last, 1, chars), F.lit("..."))).otherwise(last)


#: Where columns of the span table come from; the first key that is present gives the value.
TEXT_FIELDS = {
    "gen_ai_system": ("gen_ai.provider.name", "gen_ai.system", "az.ai.inference.model_provider", "ai.model.provider", "llm.provider"),
    "gen_ai_operation_name": ("gen_ai.operation.name",),
    "gen_ai_request_model": ("gen_ai.request.model", "ai.model.id", "llm.model_name", "embedding.model_name", "reranker.model_name"),
    "gen_ai_response_model": ("gen_ai.response.model", "llm.response.model"),
    "gen_ai_response_id": ("gen_ai.response.id",),
    "gen_ai_agent_id": ("gen_ai.agent.id", "aws.bedrock.agent.id"),
    "gen_ai_agent_name": ("gen_ai.agent.name", "agent_role", "recipient_agent_class", "sender_agent_class"),
    "gen_ai_tool_name": ("gen_ai.tool.name", "tool.name", "tool_name", "logfire.msg"),
    "gen_ai_tool_call_id": ("gen_ai.tool.call.id",),
    "http_method": ("http.method", "http.request.method"),
    "http_url": ("http.url", "url.full"),
    "db_system": ("db.system",),
    "db_name": ("db.name",),
    "db_operation": ("db.operation",),
    "db_statement": ("db.statement",),
    "storage_system": ("cloud.provider",),
    "storage_bucket": ("aws.s3.bucket", "gcp.gcs.bucket"),
    "storage_object": ("aws.s3.key", "gcp.gcs.object"),
    "messaging_system": ("messaging.system",),
    "messaging_destination": ("messaging.destination", "messaging.destination.name"),
}
#: Request parameters: key, names in the JSON of invocation parameters, type.
PARAMETERS = {
    "gen_ai_temperature": ("gen_ai.request.temperature", ("temperature",), "double"),
    "gen_ai_top_p": ("gen_ai.request.top_p", ("top_p",), "double"),
    "gen_ai_top_k": ("gen_ai.request.top_k", ("top_k",), "long"),
    "gen_ai_max_tokens": ("gen_ai.request.max_tokens", ("max_tokens", "max_output_tokens"), "long"),
    "gen_ai_frequency_penalty": ("gen_ai.request.frequency_penalty", ("frequency_penalty",), "double"),
    "gen_ai_presence_penalty": ("gen_ai.request.presence_penalty", ("presence_penalty",), "double"),
    "gen_ai_server_ttft_ms": ("gen_ai.server.time_to_first_token", (), "long"),
    "gen_ai_server_request_duration_ms": ("gen_ai.server.request_duration", (), "long"),
}
TAG_KEYS = ("tags", "langsmith.tags", "tag.tags")
ENVIRONMENT_KEYS = ("deployment.environment", "deployment.environment.name")
#: Most bytes of an exception's type and message, and of its stack trace.
MESSAGE_BYTES, TRACE_BYTES = 2048, 16_384


def _json(a: Column, key: str, *paths: str) -> Column:
    """The first of some places in the JSON of an attribute."""
    return F.coalesce(*[F.nullif(F.get_json_object(get(a, key), p), F.lit("")) for p in paths])


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that ends between characters."""
    data = text.cast("binary")
    inside = lambda at: F.hex(F.substring(data, at, 1)).rlike("^[89AB]")  # noqa: E731  a byte inside a character
    n = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substr(data, F.lit(1), n), "UTF-8"))


def finish_reasons(a: Column, events: Column) -> Column:
    """Reasons from the attribute, else the first choice event, completion JSON, output messages, or a provider's response."""
    listed = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    said = F.filter(events, lambda e: (e["name"] == "gen_ai.choice") & F.try_element_at(e["attributes"], F.lit("finish_reason")).isNotNull())
    choices = F.from_json(F.get_json_object(get(a, "gen_ai.completion"), "$.choices"), "array<struct<finish_reason: string>>")
    outputs = F.from_json(get(a, "gen_ai.output.messages"), "array<struct<finish_reason: string>>")
    reasons = lambda c: F.filter(F.transform(c, lambda x: x["finish_reason"]), lambda x: x.isNotNull())
    some = lambda c: F.when(F.size(c) > 0, c)
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    return F.coalesce(
        some(listed(get(a, "gen_ai.response.finish_reasons"))), one(F.try_element_at(F.get(said, 0)["attributes"], F.lit("finish_reason"))), some(reasons(choices)), some(F.slice(reasons(outputs), 1, 1)),
        one(F.lower(_json(a, "gcp.vertex.agent.llm_response", "$.finish_reason"))), one(_json(a, "response_data", "$.finish_reason")), F.array().cast("array<string>"),
    )


def stored_fields(a: Column, name: Column, events: Column, resource: Column, status: Column, message: Column) -> dict[str, Column]:
    """The columns of the span table that come from attributes, events, resource and status."""
    out = {c: get(a, *keys) for c, keys in TEXT_FIELDS.items()}
    asked = get(a, "request_data").isNotNull()
    has = lambda path: _json(a, "request_data", path).isNotNull()
    out["gen_ai_request_model"] = F.coalesce(out["gen_ai_request_model"], _json(a, "gcp.vertex.agent.llm_request", "$.model"), _json(a, "crew_agents", "$[0].llm"), _json(a, "request_data", "$.model"))
    out["gen_ai_system"] = F.coalesce(out["gen_ai_system"], F.when(asked & has("$.system"), "anthropic").when(asked & has("$.messages"), "openai"))
    out["gen_ai_operation_name"] = F.coalesce(out["gen_ai_operation_name"], F.when(asked & has("$.messages"), "chat"))
    out["gen_ai_tool_name"] = F.coalesce(out["gen_ai_tool_name"], F.when(name.startswith("execute_tool "), F.substring(name, 14, 1 << 20)))
    for c, (key, names, kind) in PARAMETERS.items():
        own = get(a, key).try_cast(kind)
        more = [F.get_json_object(get(a, "llm.invocation_parameters"), f"$.{n}").try_cast(kind) for n in names]
        if c == "gen_ai_max_tokens":
            more += [_json(a, "request_data", "$.max_tokens", "$.max_completion_tokens").try_cast(kind)]
        out[c] = F.coalesce(own, *more)
    out["gen_ai_stop_sequences"] = F.coalesce(F.from_json(get(a, "gen_ai.request.stop_sequences"), "array<string>"), F.array().cast("array<string>"))
    out["gen_ai_finish_reasons"] = finish_reasons(a, events)
    out["http_status_code"] = get(a, "http.status_code", "http.response.status_code").try_cast("int")
    out["tags"] = tags(*[get(a, k) for k in TAG_KEYS])
    metadata = get(a, "metadata")
    out["metadata"] = F.when(F.try_parse_json(metadata).isNotNull(), metadata)
    out["usage_details"] = F.nullif(usage_details(a), F.lit("{}"))
    out["environment"] = F.coalesce(get(resource, *ENVIRONMENT_KEYS), get(a, *ENVIRONMENT_KEYS))
    failed = (status != "ERROR") & F.coalesce(F.lower(get(a, "gen_ai.tool.status")).isin("error", "failed"), F.lit(False))
    out["status_code"] = F.when(failed, "ERROR").otherwise(status)
    first = F.get(F.filter(events, lambda e: e["name"] == "exception"), 0)["attributes"]
    of = lambda key, most: F.when((status == "ERROR") | failed, cut_bytes(F.nullif(F.try_element_at(first, F.lit(key)), F.lit("")), most))
    kind = of("exception.type", MESSAGE_BYTES)
    said = F.coalesce(of("exception.message", MESSAGE_BYTES), F.when(failed, "Tool execution failed"))
    out["exception_type"], out["exception_message"], out["exception_stacktrace"] = kind, said, of("exception.stacktrace", TRACE_BYTES)
    out["status_message"] = F.coalesce(F.nullif(message, F.lit("")), F.when(failed, "Tool execution failed"), F.nullif(F.concat_ws(": ", kind, said), F.lit("")))
    return out


def display_name(a: Column, name: Column) -> Column:
    """A template as span name gives way to the resolved name beside it."""
    resolved = F.nullif(get(a, "logfire.msg"), F.lit(""))
    return F.when(get(a, "logfire.msg_template").isNotNull(), F.coalesce(resolved, name)).otherwise(name)
