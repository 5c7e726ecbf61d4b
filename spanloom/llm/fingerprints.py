"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is a run of five words (a shorter text that has words is one shingle); its hash is the top
48 bits of xxhash64.  The sketch holds the K least different hashes in order.  Sketches of two parts
merge into the sketch of both, and estimate resemblance, containment and the number of different
shingles.  All functions here are column expressions.

Null texts count as empty, and empty texts have an empty sketch; two empty sketches are alike (1), an
empty and another are not (0).  Documents follow one another by doc_id, null ids last, those of one id by a hash of
their text, equal rows in any order; the first follows the last, and a single row follows itself.  Repeated rows
have equal fingerprints.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .words import word_array

K, WORDS, BITS = 128, 5, 48


def sketch_of_words(words: Column, k: int = K) -> Column:
    n = F.size(words)
    cut = lambda h: F.shiftrightunsigned(h, 64 - BITS)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: cut(F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)])))
    hashes = F.when(n >= WORDS, runs).when(n >= 1, F.array(cut(F.xxhash64(words)))).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return sketch_of_words(word_array(text), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k different shingles, else an estimate with relative error of about 1 / sqrt(k - 2)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * float(1 << BITS) / F.element_at(a, -1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets: the share of the merged sketch that both have."""
    both = merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """Base64 of the hashes, six bytes each, in order."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))), "\r\n", "")


def decoded(fingerprint: Column) -> Column:
    """The sketch of an encoded fingerprint."""
    digits, step = F.hex(F.unbase64(fingerprint)), BITS // 4
    n = F.length(digits) / step
    part = lambda i: F.conv(F.substr(digits, i * step + 1, F.lit(step)), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), part)).otherwise(F.array().cast("array<long>"))


def buckets(ids: DataFrame, rows_each: int = 512, most: int = 16_384) -> tuple[Column, Column]:
    """Expressions of ``doc_id`` and ``_tie`` (a hash): the number of the bucket of consecutive rows, and whether it is one of null ids.

    Borders are percentiles of the ids; at most ``most`` of them come to the driver.  An id that is several
    borders has many rows: these are dealt to as many buckets by ranges of the hash, and so are null ids.
    """
    n = ids.count()
    k = int(min(most, max(1, n // rows_each)))
    borders = ids.agg(F.percentile_approx(F.col("doc_id").cast("long"), [(i + 1) / (k + 1) for i in range(k)], 40_000)).first()[0] or []
    step = max(1, int(len(borders) ** 0.5))
    groups = [borders[i : i + step] for i in range(0, len(borders), step)]
    lasts = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    doc, no_id = F.col("doc_id").cast("long"), F.col("doc_id").isNull()
    share = F.shiftrightunsigned(F.col("_tie").bitwiseXOR(F.lit(-(1 << 63))), 33) / F.lit(float(1 << 31))  # in the order of the signed hash

    def under(strict: bool) -> Column:
        """Borders below the id (or up to it): whole groups by their last border, then inside one group."""
        beneath = (lambda x: x < doc) if strict else (lambda x: x <= doc)
        whole = F.size(F.filter(lasts, beneath))
        return whole * step + F.size(F.filter(F.coalesce(F.get(inner, whole), F.array().cast("array<bigint>")), beneath))

    low, high = under(True), under(False)
    plain = F.when(high - low > 1, low + F.floor(share * (high - low))).otherwise(high)
    return F.when(no_id, F.floor(share * k)).otherwise(plain).cast("int"), no_id


def _sketched(rows: DataFrame, k: int) -> DataFrame:
    """With the sketch of ``text``; the words are a column of their own, so a text is split once."""
    return rows.withColumn("_words", word_array(F.col("text"))).withColumn("sketch", sketch_of_words(F.col("_words"), k)).drop("_words")


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): what follows each row; the last row's is the first.

    Rows are dealt into buckets of consecutive ids, each ordered apart, so texts and sketches are shuffled once
    and a sketch is made once.  A bucket's last row gets the first row of the next bucket; buckets are bounded in number.
    """
    bucket, no_id = buckets(docs.select("doc_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.select("doc_id", "text", "_tie", no_id.alias("no_id"), bucket.alias("bucket"))
    keys = ["no_id", "bucket"]
    order = Window.partitionBy(*keys).orderBy("doc_id", "_tie", "text")
    firsts = rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    firsts = written(_sketched(firsts, k).select(*keys, "text", "sketch"), "firsts")
    # One row for each bucket.
    along = Window.orderBy(*keys)
    ring = firsts.select(*keys, F.coalesce(F.lead(F.struct(*keys)).over(along), F.first(F.struct(*keys)).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    heads = firsts.select(F.struct(*keys).alias("after"), F.col("text").alias("head"), F.col("sketch").alias("head_sketch"))
    beyond = ring.join(heads, "after").drop("after")
    lined = _sketched(rows, k).select("*", F.lead("text").over(order).alias("follower"), F.lead("sketch").over(order).alias("follower_sketch"))
    return lined.join(beyond, keys, "left").select("doc_id", "text", "sketch", F.coalesce("follower", "head").alias("next_text"), F.coalesce("follower_sketch", "head_sketch").alias("next_sketch"))


def fingerprinted(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles.

    The edited text has its last floor(n_chars / 2) code points replaced by as many, or all, of the
    next document.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs, k).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.withColumn("w_edited", word_array(F.col("edited")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch_of_words(F.col("w_edited"), k).alias("edited_sketch"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(a).alias("fingerprint"), encoded(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"), distinct_shingles(a, k).alias("n_shingles"),
    )
