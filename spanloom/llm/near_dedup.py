"""Near duplicates: BagMinHash signatures of five-word shingles, bands, exact check of the overlap.

Texts with equal content are one class (128-bit digest of the text).  Classes that share a band are
candidates; two classes are linked if the Jaccard overlap of their shingle multisets is ``threshold``
or more, computed from the whole texts.  Groups are the connected components of the links.

A band's bucket is never expanded into rows of pairs: its members are first checked against one
leader, the one that meets most others.  In buckets whose members then still lie in several groups,
the members outside the bucket's main group are compared, block against block inside tasks, with those in it
and among themselves.  What is left out are pairs that are in one group already, so groups are those of all
candidate pairs.  The work on such a bucket grows with its members times those outside its main group.

Buckets and leaders may have any number of rows: joins on them are salted, see :mod:`skew`.

Null texts count as empty; texts without words are alike only if equal; a short text with words is one
shingle.  A group keeps its row of least doc_id (nulls last), of equal rows one; a text that repeats is compared once.
An empty table gives an empty result.  Extra columns pass through :func:`deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import COMPONENTS, bands, signatures
from .bytes import counted, groups, mix, shingles, utf8, words
from .components import components
from .skew import salted_join
from .storage import discard, small_batches, written

WORDS, THRESHOLD, BLOCK, BLOCK_BYTES, COLUMNS = 5, 0.8, 128, 1 << 20, 8192
_NO_ID = (1 << 63) - 1


def _key(docs: DataFrame) -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("class")]


def band_rows(docs: DataFrame, m: int = COMPONENTS, k: int = WORDS) -> DataFrame:
    """did, class, size in bytes and the band hashes (none for a text without words) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in groups(offsets):
                w = words(data, offsets[i : j + 1])
                doc, hashes, times = counted(*shingles(w, k))
                out = bands(signatures(doc, hashes, times, j - i, m)).view(np.int64)
                empty = np.diff(w.bounds) == 0
                ends = np.concatenate([[0], np.cumsum(np.where(empty, 0, out.shape[1]))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out[~empty].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), lists], ["did", "class", "size", "bands"])

    return docs.select(*_key(docs), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "did long, class binary, size long, bands array<long>")


def overlap(pairs: DataFrame, texts: DataFrame, k: int = WORDS) -> DataFrame:
    """``pairs`` (a, b; a written table) with the Jaccard overlap of the two texts' shingle multisets."""

    def bag(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = utf8(column.slice(i, j - i))
        return counted(*shingles(words(data, offsets), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, one = utf8(batch.column(2))
            _, two = utf8(batch.column(3))
            for i, j in groups((one - one[0]) + (two - two[0])):
                (d1, h1, t1), (d2, h2, t2) = bag(batch.column(2), i, j), bag(batch.column(3), i, j)
                doc, hashes, times = np.concatenate([d1, d2]), np.concatenate([h1, h2]), np.concatenate([t1, t2])
                order = np.lexsort((hashes, doc))
                doc, hashes, times = doc[order], hashes[order], times[order]
                same = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
                shared = np.bincount(doc[same], np.minimum(times[same], times[same + 1]), j - i)
                every = np.bincount(doc, times, j - i) - shared
                share = np.divide(shared, every, out=np.zeros(j - i), where=every > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(share)], ["a", "b", "overlap"])

    small_batches(pairs.sparkSession)
    times = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    joined = salted_join(pairs, texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a", ["b"], times("a"))
    joined = salted_join(joined, texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b", ["a"], times("b"))
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, overlap double")


def spanning_links(texts: pa.Array, roots: np.ndarray, threshold: float, k: int = WORDS) -> list[tuple[int, int]]:
    """Of all pairs of texts of different roots with an overlap of ``threshold`` or more, enough to connect what they connect."""
    n = len(texts)
    data, offsets = utf8(texts)
    doc, hashes, times = (np.concatenate(x) for x in zip(*((d + i, h, t) for i, j in groups(offsets) for d, h, t in [counted(*shingles(words(data, offsets[i : j + 1]), k))]), strict=True))
    total = np.bincount(doc, times, n)
    # The r-th copy of a shingle is an element of its own: multisets become sets.
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc, element = np.repeat(doc, times), mix(np.repeat(hashes, times) + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, column, often = np.unique(element, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    order = np.argsort(column[keep], kind="stable")
    doc, column = doc[keep][order], np.cumsum(np.diff(column[keep][order], prepend=-1) > 0) - 1
    common = np.zeros((n, n))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[doc[i:j], column[i:j] - lo] = 1
        common += part @ part.T
    every = total[:, None] + total[None, :] - common
    share = np.divide(common, every, out=np.zeros((n, n)), where=every > 0)
    parent = {r: r for r in roots.tolist()}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(share >= threshold, 1) & (roots[:, None] != roots[None, :])), strict=True):
        one, two = top(int(roots[i])), top(int(roots[j]))
        if one != two:
            parent[one] = two
            out.append((int(i), int(j)))
    return out


def cross_links(placed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes of different groups in a bucket, from the written ``placed`` (class, size, bucket, root).

    Members in the bucket's main group and others are cut by hash, apart, into blocks of about ``BLOCK`` and ``BLOCK_BYTES``.  Each block of
    others meets each of the main group and each of others in one task, which holds the texts of both, compares all
    pairs and returns links that connect them: no pair is a row, and blocks of the main group do not meet.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, text = rows["class"].to_pylist(), rows["text"].combine_chunks()
        roots = np.unique(np.array([x.hex() for x in rows["root"].to_pylist()]), return_inverse=True)[1]
        found = spanning_links(text, roots, threshold)
        ends = [[ids[x[side]] for x in found] for side in (0, 1)]
        return pa.table({"a": pa.array(ends[0], pa.binary()), "b": pa.array(ends[1], pa.binary())})

    counts = written(placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "roots")
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    sizes = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("top"))
    dealt = sizes.select("bucket", F.col("top.root").alias("main"), blocks(F.col("top.n"), F.col("top.size")).alias("mains"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("others"))
    rows = salted_join(placed.drop("size"), dealt, "bucket", ["class"], sizes.select("bucket", "n"))
    rows = rows.withColumn("inside", F.col("root") == F.col("main")).withColumn("block", F.pmod(F.xxhash64("class", "bucket"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda among, i, j: F.struct(F.lit(among).alias("among"), i.alias("i"), j.alias("j"))
    block = F.col("block")
    outside = F.concat(F.transform(upto("mains"), lambda i: task(False, i, block)), F.transform(upto("others"), lambda k: task(True, F.least(block, k), F.greatest(block, k))))
    tasks = F.when(F.col("inside"), F.transform(upto("others"), lambda j: task(False, block, j))).otherwise(outside)
    rows = rows.select("class", "root", "bucket", F.explode(tasks).alias("task")).join(texts, "class")
    return rows.select("class", "root", "text", "bucket", "task.*").groupBy("bucket", "among", "i", "j").applyInArrow(run, "a binary, b binary")


def class_groups(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A written table with (id, root) of the classes that have a near duplicate, from the written ``rows`` of :func:`band_rows`."""
    classes = rows.groupBy("class").agg(F.first("bands").alias("bands"), F.min("did").alias("did"), F.max("size").alias("size"))
    banded = classes.select("class", "did", "size", F.explode("bands").alias("bucket"))
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = written(salted_join(banded, shared, "bucket", ["class"], shared), "members")
    asked = members.select("did", "class").distinct()
    texts = docs.select(*_key(docs), F.coalesce("text", F.lit("")).alias("text")).join(asked, ["did", "class"]).dropDuplicates(["did", "class"])
    texts = written(texts.select("class", "text"), "texts")

    # The leader of a bucket is its member that meets most others, over all its buckets.
    known = members.groupBy("class").agg(F.sum("n").alias("meets"))
    led = members.join(known, "class").groupBy("bucket").agg(F.max(F.struct("meets", "class")).alias("lead")).select("bucket", F.col("lead.class").alias("leader"))
    pairs = salted_join(members.select("bucket", "class"), written(led, "leaders"), "bucket", ["class"], shared).filter("class <> leader")
    pairs = written(pairs.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct(), "pairs")
    links = written(overlap(pairs, texts).filter(F.col("overlap") >= threshold).select("a", "b"), "links")
    found = components(links)

    groups_of = found.select(F.col("id").alias("class"), "root")
    placed = members.select("class", "size", "bucket", "n").join(groups_of, "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("two"), F.count("*").alias("n")).filter("one < two").select("bucket", "n")
    mixed = written(mixed, "mixed")
    open_ = written(salted_join(placed.drop("n"), mixed.select("bucket"), "bucket", ["class"], mixed), "open")
    more = written(cross_links(open_, texts, threshold), "cross-links")
    if not more.isEmpty():
        discard(found)
        found = components(links.unionByName(more))
    discard(shared, members, texts, pairs, links, mixed, open_, more)
    return found


def grouped(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """did, class, root of every row, and of its root the least did and with it the least class."""
    rows = written(band_rows(docs), "bands")
    found = class_groups(docs, rows, threshold)
    placed = rows.select("did", "class").join(found.select(F.col("id").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = written(placed, "groups")
    discard(rows, found)
    first = placed.groupBy("root").agg(F.min("did").alias("first_did"))
    first = placed.join(first, "root").filter("did = first_did").groupBy("root", "first_did").agg(F.min("class").alias("first_class"))
    return placed.join(written(first, "firsts"), "root")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the doc_id of the row that stays of its group) and kept, for every row.

    Of rows with equal id and text all are marked as kept; :func:`deduplicated` lets one stay.
    """
    no = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    kept = (F.col("did") == F.col("first_did")) & (F.col("class") == F.col("first_class"))
    return grouped(docs, threshold).select(no("did").alias("doc_id"), no("first_did").alias("class_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay, one of each group, with their columns."""
    kept = grouped(docs, threshold).filter("did = first_did and class = first_class").select("did", "class").distinct()
    columns = [F.col(f"`{c}`").alias(f"_in_{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*_key(docs), *columns).join(written(kept, "kept"), ["did", "class"], "left_semi")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("did", "class").orderBy(F.lit(0)))).filter("_nth = 1")
    return rows.select(*[F.col(f"_in_{k}").alias(c) for k, c in enumerate(docs.columns)])
