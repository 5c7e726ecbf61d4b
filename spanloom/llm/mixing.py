"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

Sources in code-point order, null last, weigh ``WEIGHTS`` in turn and share the words of all
documents.  A source stops at ``max_epochs`` times its own words; the excess goes to the others by
weight until none is above.  In closed form: order sources by cap over weight; one is capped if its
cap is below its share of what the capped ones before it leave.

A source is then taken whole as often as its target holds it, and a seeded part once more: documents
in the order of a seeded digest, up to the document whose middle passes the rest.  The part is found
from sums over (source, first digits of the digest) and the rows of one such block for each source,
so no task orders a source.

Null texts have no words; null sources are a source of their own; rows with equal id and text are
taken or left together; an empty table gives an empty result.  Every table here but the documents'
has at most 4096 rows for each source; the table of targets has a row for each source and is ordered in one task, so
sources are meant to be thousands (crawls, collections), not each host of the web.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .words import n_words

WEIGHTS = (5, 2, 1)
_DIGITS = 3


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _digest(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source key, source_size), one row a source, with target, whole and rest (words)."""
    every = Window.partitionBy()
    big = lambda c: F.col(c).cast("decimal(38,0)")
    by = Window.orderBy("_key_null", "_key")
    rows = sizes.withColumn("_key", F.col("skey")).withColumn("_key_null", (F.col("skey") == "n").cast("int"))
    nth = F.pmod(F.row_number().over(by) - 1, F.lit(len(weights)))
    rows = rows.withColumn("w", F.get(F.array(*[F.lit(x).cast("long") for x in weights]), nth)).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    rows = rows.withColumn("total", F.sum("source_size").over(every))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "_key_null", "_key")
    rows = rows.withColumn("gone", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("w_left", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("capped", big("cap") * F.col("w_left") < big("w") * (F.col("total") - F.col("gone")))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    rows = rows.withColumn("free", free).withColumn("share", F.col("w") * left)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("share").cast("double") / F.col("free"))
    whole = F.when(F.col("capped"), F.lit(max_epochs).cast("long")).when(F.col("source_size") > 0, F.floor(target / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("target", target).withColumn("whole", whole)
    return rows.select("skey", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def plan(rows: DataFrame) -> DataFrame:
    """From (skey, digest, size) of all documents, a row for each source: targets and where the part taken once more ends."""
    block = F.substring("digest", 1, _DIGITS)
    blocks = written(rows.groupBy("skey", block.alias("block")).agg(F.sum("size").alias("n")), "mix-blocks")
    goal = written(targets(blocks.groupBy("skey").agg(F.sum("n").alias("source_size"))), "mix-targets")
    sums = blocks.withColumn("end", F.sum("n").over(Window.partitionBy("skey").orderBy("block"))).join(goal, "skey")
    full = sums.filter(F.col("end") <= F.col("rest")).groupBy("skey").agg(F.max("block").alias("full_to"))
    start = F.col("end") - F.col("n")
    cut = written(sums.filter((start < F.col("rest")) & (F.col("end") > F.col("rest"))).select("skey", "block", start.alias("start"), "rest"), "mix-cut")
    keys = rows.withColumn("block", block).join(cut, ["skey", "block"]).groupBy("skey", "block", "digest").agg(F.sum("size").alias("size"), F.max("start").alias("start"), F.max("rest").alias("rest"))
    end = F.col("start") + F.sum("size").over(Window.partitionBy("skey", "block").orderBy("digest"))
    taken = keys.withColumn("end", end).filter(2 * F.col("end") - F.col("size") <= 2 * F.col("rest")).groupBy("skey").agg(F.max("digest").alias("part_to"))
    return written(goal.join(full, "skey", "left").join(taken, "skey", "left"), "mix-plan")


def _repeats() -> Column:
    part = (F.substring("digest", 1, _DIGITS) <= F.col("full_to")) | (F.col("digest") <= F.col("part_to"))
    return F.col("whole") + F.coalesce(part, F.col("digest") <= F.col("part_to"), F.lit(False)).cast("long")


def mix(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """doc_id, size, source, source_size, target, repeats, taken of every document."""
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _source().alias("skey"), _digest(seed).alias("digest")), "mix-rows")
    return rows.join(plan(rows), "skey").select(
        "doc_id", "size", "source", "source_size", "target", _repeats().alias("repeats"), (F.col("size") * _repeats()).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """The documents as often as the mix takes them, with their columns; no text is shuffled.

    Documents without words are taken as their source is; an empty table gives an empty result.
    """
    rows = written(docs.select(n_words(F.col("text")).alias("size"), _source().alias("skey"), _digest(seed).alias("digest")), "mix-rows")
    names = [F.col(f"`{c}`") for c in docs.columns]
    dealt = docs.select(*[F.col(f"`{c}`").alias(f"_in_{k}") for k, c in enumerate(docs.columns)], _source().alias("skey"), _digest(seed).alias("digest")).join(plan(rows), "skey")
    dealt = dealt.withColumn("n", _repeats()).filter(F.col("n") > 0)
    out = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(*[F.col(f"_in_{k}").alias(c) for k, c in enumerate(docs.columns)]) if names else out
