"""Token attribution: nested spans repeat the same usage, and each token counts once.

A span with tokens counts if it is a generation without a child generation that has tokens, or if it
is of another known type, its trace has no generation with tokens, and its parent has no tokens.
The evidence is taken from all rows, also from those that a filter or the time range leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_roots(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rows of ``rows`` that count.

    Facts about a node of a trace (it has tokens, it has a child generation with tokens) are combined before they are
    shuffled; a generation looks up itself, another span its parent, so one join finds both and no row holds a trace.
    """
    used = F.col("input_tokens") + F.col("output_tokens") > 0
    gen = F.coalesce(F.col("observation_type") == "generation", F.lit(False))
    trace = ["project_id", "trace_id"]
    seen = evidence.filter(used).select(*trace, "span_id", "parent_span_id", gen.alias("gen"))
    facts = seen.select(*trace, F.explode(F.array(F.struct(F.col("span_id").alias("_node"), F.lit(True).alias("_has_tokens"), F.lit(False).alias("_gen_child")), F.struct(F.col("parent_span_id").alias("_node"), F.lit(False).alias("_has_tokens"), F.col("gen").alias("_gen_child")))).alias("f"))
    facts = facts.select(*trace, "f.*").filter("_node is not null").groupBy(*trace, "_node").agg(F.max("_has_tokens").alias("_has_tokens"), F.max("_gen_child").alias("_gen_child"))
    with_gen = seen.filter("gen").select(*trace).distinct().withColumn("_has_gen", F.lit(True))
    asked = rows.filter(used & F.col("observation_type").isNotNull()).withColumn("_node", F.when(gen, F.col("span_id")).otherwise(F.col("parent_span_id")))
    found = asked.join(facts, [*trace, "_node"], "left").join(with_gen, trace, "left")
    keep = F.when(gen, ~F.coalesce("_gen_child", F.lit(False))).otherwise(F.col("_has_gen").isNull() & ~F.coalesce("_has_tokens", F.lit(False)))
    return found.filter(keep).select(*rows.columns)
