"""Prices of model use: candidate names in order of confidence, looked up in a small price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Providers and the names that telemetry gives them.
PROVIDERS = {
    "openai": ("openai",), "anthropic": ("anthropic",), "cohere": ("cohere",), "mistral": ("mistral",), "bedrock": ("aws_bedrock", "aws.bedrock", "bedrock", "amazon_bedrock"),
    "azure": ("azure", "azure_openai", "azure.openai", "azureopenai"), "gemini": ("google", "gemini", "google_ai_studio", "google_adk", "googleadk"), "vertex_ai": ("vertex", "vertex_ai", "vertexai", "google_vertexai"),
    "groq": ("groq",), "together_ai": ("together", "together_ai", "togetherai"), "fireworks_ai": ("fireworks", "fireworks_ai"), "deepinfra": ("deepinfra", "deep_infra"), "perplexity": ("perplexity",),
    "replicate": ("replicate",), "ollama": ("ollama",), "xai": ("xai", "x.ai", "grok"), "ai21": ("ai21", "ai21_chat"), "openrouter": ("openrouter", "open_router"), "databricks": ("databricks",),
    "watsonx": ("watsonx", "watson_x", "ibm_watsonx"),
}
REGION = "^(global|us|eu|ap|me|sa|ca|af|il|mx)\\.(?=.)"
ROUTING = ":(free|extended|nitro|beta|thinking|exacto)$"
#: The parts of a cost, and their sum.
PARTS = ("cost_input", "cost_output", "cost_cache_read", "cost_cache_write", "cost_reasoning", "cost_total")
#: Confidence of an exact name, a provider's prefix, an alias, a family.
EXACT, PREFIX, ALIAS, FAMILY = 1.0, 0.95, 0.85, 0.70


def provider(system: Column) -> Column:
    """Null for frameworks and unknown names."""
    names = F.create_map(*[F.lit(x) for to, names in PROVIDERS.items() for name in names for x in (name, to)])
    return F.try_element_at(names, F.lower(system))


def _undated(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "-\\d{8}$", ""), "-\\d{4}-\\d{2}-\\d{2}$", "")


def candidates(system: Column, model: Column) -> Column:
    """(name, confidence) in order; the first that has a price wins.  A form that does not apply is null."""
    low, by = F.lower(model), provider(system)
    part = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    join = lambda a, b: F.concat(a if isinstance(a, Column) else F.lit(a), F.lit("/"), b)
    tail = part("^[^/]*/(.+)$")
    colon, after = provider(part("^([^:]{1,20}):.")), part("^[^:]{1,20}:(.+)$")
    after = F.when(colon.isNotNull(), after)
    resource, version = part("/models/(.+)$"), part("^([^/]*/.*?):[0-9a-f]{12,}$")
    tuned = F.coalesce(part("^ft:([^:]+):"), part("^([^:]+):ft[-:]"))
    plain = F.regexp_replace(F.regexp_replace(low, "(-latest|:latest)+$", ""), ROUTING, "")
    plain = F.regexp_replace(F.regexp_replace(plain, "@\\d{8}$", ""), "-v\\d+:\\d+$", "")
    base = _undated(low)
    pairs = [
        (low, EXACT), (F.regexp_replace(low, REGION, ""), EXACT), (tail, PREFIX), (F.regexp_replace(tail, REGION, ""), PREFIX), (join(colon, after), PREFIX), (after, EXACT),
        (resource, EXACT), (join("vertex_ai", resource), PREFIX), (join("gemini", resource), PREFIX), (version, EXACT), (join("replicate", version), PREFIX), (tuned, ALIAS), (_undated(tuned), FAMILY),
        (join(by, low), PREFIX), (join(by, plain), ALIAS), (plain, ALIAS), (join(by, base), FAMILY), (base, FAMILY),
    ]
    return F.filter(F.array(*[F.struct(n.alias("name"), F.lit(c).alias("confidence")) for n, c in pairs]), lambda x: x["name"].isNotNull())


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """``rows`` (system, model, token counts) with the parts of the cost, their sum and confidence; unknown models cost 0.

    Each distinct model is looked up once.  The price table is joined by its own size.  Columns for cached and
    reasoning tokens, and their prices, may be missing.
    """
    models = rows.select("system", "model").distinct().select("system", "model", F.posexplode(candidates(F.col("system"), F.col("model"))).alias("priority", "c"))
    price = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in prices.columns else F.lit(0.0)
    caches = F.coalesce(F.col("supports_caching"), F.lit(False)) if "supports_caching" in prices.columns else F.lit(False)
    write, thought = price("cache_write_cost"), price("reasoning_cost")
    fields = {"i": price("input_cost"), "o": price("output_cost"), "r": price("cache_read_cost"), "w": F.when((write == 0) & caches, price("input_cost")).otherwise(write), "t": F.when(thought > 0, thought).otherwise(price("output_cost"))}
    usable = prices.filter("(input_cost > 0 or output_cost > 0) and input_cost >= 0 and output_cost >= 0").select(F.lower("price_model").alias("_name"), F.lower("mode").alias("mode"), *[e.alias(n) for n, e in fields.items()])
    hit = models.join(usable, F.col("c.name") == F.col("_name")).groupBy("system", "model").agg(F.min_by(F.struct("i", "o", "r", "w", "t", "mode", F.col("c.confidence").alias("confidence")), "priority").alias("p"))
    keys = [F.col("a.system").eqNullSafe(F.col("h.system")), F.col("a.model").eqNullSafe(F.col("h.model"))]
    rows = rows.drop(*PARTS)
    joined = rows.alias("a").join(hit.alias("h"), keys, "left")
    count = lambda c: F.greatest(F.coalesce(F.col("a." + c), F.lit(0)), F.lit(0)) if c in rows.columns else F.lit(0)
    none = F.lit(0.0)
    embedding = F.col("h.p.mode") == "embedding"
    parts = {
        "cost_input": count("input_tokens") * F.col("h.p.i"), "cost_output": F.when(embedding, none).otherwise(count("output_tokens") * F.col("h.p.o")), "cost_cache_read": count("cache_read_tokens") * F.col("h.p.r"),
        "cost_cache_write": count("cache_write_tokens") * F.col("h.p.w"), "cost_reasoning": F.when(embedding, none).otherwise(count("reasoning_tokens") * F.col("h.p.t")),
    }
    money = lambda c: F.coalesce(c, none).cast("decimal(18,6)")
    total = parts["cost_input"] + parts["cost_output"] + parts["cost_cache_read"] + parts["cost_cache_write"] + parts["cost_reasoning"]
    return joined.select("a.*", *[money(v).alias(c) for c, v in parts.items()], money(total).alias("cost_total"), F.coalesce(F.col("h.p.confidence"), none).alias("confidence"))
