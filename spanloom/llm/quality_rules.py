"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule of ``RULES`` looks at counters of one text and votes good (1), bad (-1) or abstains (0).
Texts with equal votes share a pattern, and there are at most 3 ** len(RULES) patterns, so EM runs on
the counts of the patterns of texts that pass the base rule: it estimates, for good and bad texts apart, how often each rule casts
each vote, and the share of good texts.  The posterior probability of a pattern then decides its
texts.  All of it is DataFrame expressions.

Null texts count as empty; empty texts have no words and fail the base rule.  Repeated rows are judged
alike.  An empty table gives an empty result.  :func:`kept_documents` returns the input's columns
whatever their names; only ``text`` is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import SPACES, word_array

#: The counters, from ``text`` (not null) and ``words`` (its words).
COUNTERS = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper n_letters n_exclaim n_ends n_distinct".split()


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column) -> Column:
    """Words that lie in a run of three words found twice or more in the text.

    The runs' 64-bit hashes are sorted with their places; equal neighbours are repeats, and each
    repeated place covers three words less those that the next repeated place covers.
    """
    n = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    # A text with as many different hashes as runs repeats none: most texts end here.
    hashes = F.col("_sl_runs.h")
    ordered = F.sort_array(F.col("_sl_runs"))
    return n, runs, hashes, ordered


def counters(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``_sl_counts`` of the counters."""
    text, words = F.col("_sl_text"), F.col("_sl_words")
    n, runs, hashes, ordered = repeat_words(words)
    ordered = F.col("_sl_order")
    hit = F.filter(
        ordered,
        lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]),
    )
    places = F.col("_sl_places")
    repeated = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("_sl_text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("_sl_words", word_array(text))
    out = out.withColumn("_sl_runs", F.when(n >= 4, runs))
    out = out.withColumn("_sl_order", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.col("_sl_runs"))))
    out = out.withColumn("_sl_places", F.sort_array(F.transform(hit, lambda x: x["i"])))
    out = out.withColumn("_sl_lines", lines)
    tight = F.regexp_replace(text, SPACES, "")
    out = out.withColumn("_sl_tight", tight)
    tight = F.col("_sl_tight")
    chars = F.length(tight)
    values = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": chars - _without(tight, "[#*$%&|<>]"),
        "n_lines": F.size("_sl_lines"),
        "n_dup_lines": F.size("_sl_lines") - F.size(F.array_distinct("_sl_lines")),
        "n_repeat_words": F.coalesce(repeated, F.lit(0)),
        "n_upper": chars - _without(tight, "\\p{Lu}"),
        "n_letters": chars - _without(tight, "\\p{L}"),
        "n_exclaim": chars - _without(tight, "[!?]"),
        "n_ends": n - F.size(F.filter(words, lambda w: ~w.rlike("[.!?]\\z"))),
        "n_distinct": F.size(F.array_distinct(words)),
    }
    # A generator of one row: no filter above is pushed below it, where it would count everything again.
    out = out.withColumn("_sl_counts", F.explode(F.array(F.struct(*[values[k].cast("long").alias(k) for k in COUNTERS]))))
    return out.drop("_sl_text", "_sl_words", "_sl_runs", "_sl_order", "_sl_places", "_sl_lines", "_sl_tight")


#: name: (good if, bad if) as SQL over the counters, bad first; neither: abstains.
RULES = {
    "length": ("n_words >= 100", "n_words < 20"),
    "repetition": ("10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "symbols": ("200 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    "lines": ("n_lines >= 3 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "word_length": ("word_chars between 3 * n_words and 9 * n_words", "2 * word_chars < 5 * n_words or word_chars > 14 * n_words"),
    "case": ("100 * n_upper <= 15 * n_letters", "2 * n_upper > n_letters"),
    "exclamations": ("50 * n_exclaim <= n_words", "5 * n_exclaim > n_words"),
    # Beyond 2,000 words a text's vocabulary grows with the root of its length, and so do the thresholds.
    "vocabulary": ("10 * n_distinct >= 4 * n_words or n_distinct * n_distinct >= 320 * n_words", "5 * n_distinct < n_words and n_distinct * n_distinct < 80 * n_words"),
    "sentences": ("n_ends > 0 and n_words between 3 * n_ends and 60 * n_ends", "n_words >= 60 and (n_ends = 0 or 10 * n_ends > 7 * n_words)"),
    "letters": ("100 * n_letters >= 94 * word_chars", "100 * n_letters < 90 * word_chars"),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: EM rounds, smoothing, and the posterior from which a text is kept.
ROUNDS, SMOOTHING, KEEP_FROM = 20, 0.5, 0.5


def _over(sql: str, prefix: str = "_sl_counts.") -> str:
    return re.sub(rf"\b({'|'.join(COUNTERS)})\b", rf"{prefix}\1", sql)


def votes() -> Column:
    """The votes as a number in base 3: digit j is rule j's vote plus 1."""
    terms = [f"{3**j} * case when {_over(bad)} then 0 when {_over(good)} then 2 else 1 end" for j, (good, bad) in enumerate(RULES.values())]
    return F.coalesce(F.expr(" + ".join(terms)).cast("int"), F.lit(0))


def posteriors(patterns: DataFrame, times: Column | None = None) -> DataFrame:
    """pattern, posterior from a column ``pattern``: EM over the counts of the patterns.

    One row holds all patterns (at most 3 ** len(RULES)); a round is a step of ``aggregate``.
    """
    k = len(RULES)
    digit = lambda p, j: F.pmod(F.floor(p / F.lit(3) ** j), F.lit(3)).cast("int")
    start = sum((F.when(digit(F.col("pattern"), F.lit(j)) == 0, -2.5).when(digit(F.col("pattern"), F.lit(j)) == 2, 0.5).otherwise(0.0) for j in range(k)), F.lit(1.0))
    table = (
        patterns.groupBy("pattern")
        .agg((F.count("*") if times is None else times).cast("double").alias("n"))
        .select("pattern", "n", F.array(*[F.lit(3 * j) + digit(F.col("pattern"), F.lit(j)) for j in range(k)]).alias("at"), (1 / (1 + F.exp(-start))).alias("q"))
    )
    one = table.agg(F.sort_array(F.collect_list(F.struct("pattern", "n", "at", "q"))).alias("p"))
    p = F.col("p")
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    total = F.col("total")

    def weigh(q: Column) -> Column:
        """Log likelihood ratios good : bad of every (rule, vote), then of the prior."""
        both = F.zip_with(p, q, lambda x, y: F.struct(x["n"].alias("n"), x["at"].alias("at"), y.alias("q")))
        good = add(both, lambda x: x["n"] * x["q"])

        def ratio(e: Column) -> Column:
            mine = lambda f: add(both, lambda x: F.when(F.array_contains(x["at"], e), f(x)).otherwise(0.0))
            return F.log((mine(lambda x: x["n"] * x["q"]) + SMOOTHING) / (good + 3 * SMOOTHING)) - F.log(
                (mine(lambda x: x["n"] * (1 - x["q"])) + SMOOTHING) / (total - good + 3 * SMOOTHING)
            )

        prior = F.log((good + 1) / (total - good + 1))
        return F.concat(F.transform(F.sequence(F.lit(0), F.lit(3 * k - 1)), ratio), F.array(prior))

    def step(q: Column, _: Column) -> Column:
        def expect(r: Column) -> Column:
            return F.transform(p, lambda x: 1 / (1 + F.exp(-(F.get(r, F.lit(3 * k)) + add(x["at"], lambda e: F.get(r, e))))))

        return F.get(F.transform(F.array(weigh(q)), expect), F.lit(0))

    fitted = one.withColumn("total", add(p, lambda x: x["n"])).select(
        "p", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.transform(p, lambda x: x["q"]), step).alias("q")
    )
    both = F.arrays_zip(F.col("p.pattern").alias("pattern"), F.col("q").alias("q"))
    return fitted.select(F.explode(both).alias("x")).select(F.col("x.pattern").alias("_sl_votes"), F.round("x.q", 6).alias("_sl_posterior"))


def judged(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the counters, base_failed, posterior, kept of every row; the texts are read once."""
    rows = counters(docs.select("doc_id", "text")).select("doc_id", "_sl_counts", votes().alias("_sl_votes"))
    rows = written(rows.select("doc_id", "_sl_counts.*", "_sl_votes"), "rules")
    failed = F.expr(BASE_FAILED)
    table = posteriors(rows.filter(~failed).select(F.col("_sl_votes").alias("pattern")))
    return rows.join(F.broadcast(table), "_sl_votes", "left").select(
        "doc_id", *COUNTERS, failed.alias("base_failed"), F.col("_sl_posterior").alias("posterior"), (~failed & (F.col("_sl_posterior") >= keep_from)).alias("kept")
    )


def kept_documents(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows that pass, with their columns.  Texts are counted once and written with their votes; no text is shuffled."""
    # A failed text has the pattern -1, which finds no partner.
    key = F.coalesce(F.when(F.expr(_over(BASE_FAILED)), -1).otherwise(votes()), F.lit(-1))
    columns = [F.col(f"`{c}`").alias(f"_in_{k}") for k, c in enumerate(docs.columns)]
    rows = written(counters(docs.select(*columns, "text")).select(*[f"_in_{k}" for k in range(len(columns))], key.alias("_sl_votes")), "voted")
    table = written(posteriors(rows.filter("_sl_votes >= 0").select(F.col("_sl_votes").alias("pattern"))), "posteriors")
    good = table.filter(F.col("_sl_posterior") >= keep_from).select("_sl_votes")
    return rows.join(F.broadcast(good), "_sl_votes", "left_semi").select(*[F.col(f"_in_{k}").alias(c) for k, c in enumerate(docs.columns)])
