"""Substring dedup: repeated runs of sentences stay in the first text that has them.

A sentence ends at a word that ends in ``.``, ``!`` or ``?``, or before a line feed; sentences longer
than ``PIECE`` words are cut before the word of least hash (the last of equals) of every ``PIECE // 2``
consecutive ones.  The words alone decide, so pieces of a passage are the same at any offset: of 51
repeated words inside long sentences, a run is always found.  From every sentence goes the shortest run of
at least ``sentences`` sentences and ``min_words`` words, within the text; ``min_words=0`` gives plain runs of a fixed
number of sentences, which also take short phrases from texts that repeat nothing else (figures in the README).
Runs are the same if both of their 64-bit hashes are.  A run that an earlier place of the text has, or an earlier
text, loses its sentences, with the white space behind them.  What stays is byte for byte as it was.

Texts are ordered by doc_id, null ids last, those of one id by a hash of the row; of equal rows any one comes first.
Null texts stay null and empty ones empty; texts shorter than a run are left alone.  An empty table gives an
empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytes import groups, mix, spans_hash, utf8, words
from .storage import discard, small_batches, written

SENTENCES, MIN_WORDS, PIECE = 3, 20, 16
_NO_ID = (1 << 63) - 1
_OWN = ("text", "places", "every")
_SECOND = np.uint64(0xA0761D6478BD642F)
_GROUP = 1 << 20  # bytes of texts worked on at once
_SHIFT = 20  # of a run's first sentence, beside their number


def _least(hashes: np.ndarray, window: int, sentence: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Place of the least hash, the last of equals, of each window of words inside one long sentence."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window):
        lower = hashes[k : k + n] <= least
        least[lower], at[lower] = hashes[k : k + n][lower], k
    inside = long[:n] & (sentence[:n] == sentence[window - 1 :])
    return (np.arange(n) + at)[inside]


class Runs:
    """The sentences of a group of texts, and the run from each: its text, first sentence, number, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sentences: int = SENTENCES, min_words: int = MIN_WORDS, piece: int = PIECE):
        w = words(data, offsets)
        n, here = len(w.starts), data[offsets[0] : offsets[-1]]
        lines = np.concatenate([[0], np.cumsum(here == 0x0A)])
        stop = np.isin(here[w.ends - 1], np.frombuffer(b".!?", np.uint8)) if n else np.zeros(0, bool)
        begins = np.ones(n, bool)
        if n > 1:
            begins[1:] = stop[:-1] | (w.doc[1:] != w.doc[:-1]) | (lines[w.starts[1:]] > lines[w.ends[:-1]])
        heads = np.flatnonzero(begins)
        size = np.diff(np.append(heads, n))
        begins[_least(w.hashes, piece // 2, np.repeat(np.arange(len(heads)), size), np.repeat(size > piece, size))] = True
        self.first = np.flatnonzero(begins)  # first word of each sentence or piece
        self.doc = w.doc[self.first]
        self.bounds = np.searchsorted(self.doc, np.arange(len(offsets)))
        ends = np.append(self.first, n)[1:]
        number = np.arange(len(self.first))
        last = np.maximum(number + sentences - 1, np.searchsorted(ends, self.first + min_words, "left"))
        fits = last < self.bounds[1:][self.doc]
        self.run_at = number[fits]
        self.run_to = last[fits]
        self.run_doc = self.doc[fits]
        self.run_hash = spans_hash(w.hashes, self.first[fits], ends[self.run_to])
        self.run_hash2 = spans_hash(mix(w.hashes ^ _SECOND), self.first[fits], ends[self.run_to])
        self.starts = w.starts[self.first]  # first byte of each sentence
        order = np.lexsort((self.run_at, self.run_hash2, self.run_hash, self.run_doc))
        same = np.ones(max(0, len(order) - 1), bool)
        for key in (self.run_doc, self.run_hash, self.run_hash2):
            same &= key[order][1:] == key[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] = same
        self.run_again = np.zeros(len(order), bool)  # an earlier place of the text has it
        self.run_again[order] = again


def spans(docs: DataFrame, *rule: int) -> DataFrame:
    """did, row, hash, hash2, place of every run, once for each text: place is first sentence << 20 | number of sentences."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            did, row = (batch.column(c).to_numpy() for c in (0, 1))
            for i, j in groups(offsets, _GROUP):
                r = Runs(data, offsets[i : j + 1], *rule)
                new = ~r.run_again
                doc, at, to = r.run_doc[new], r.run_at[new], r.run_to[new]
                place = ((at - r.bounds[doc]) << _SHIFT) | (to - at + 1)
                found = (did[i + doc], row[i + doc], r.run_hash[new].view(np.int64), r.run_hash2[new].view(np.int64), place)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["did", "row", "hash", "hash2", "place"])

    return docs.select("did", "row", "text").mapInArrow(run, "did long, row long, hash long, hash2 long, place long")


def without_runs(docs: DataFrame, *rule: int) -> DataFrame:
    """From text, places (of runs to remove), every (all runs go) and carried columns: text without them, n_sentences, n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column, places = batch.column(names.index("text")), batch.column(names.index("places"))
            data, offsets = utf8(column)
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            every = batch.column(names.index("every")).to_numpy(zero_copy_only=False)
            for i, j in groups(offsets, _GROUP):
                r = Runs(data, offsets[i : j + 1], *rule)
                cover = np.zeros(len(r.first) + 1, np.int64)
                again = r.run_again | every[i + r.run_doc]
                np.add.at(cover, r.run_at[again], 1)
                np.add.at(cover, r.run_to[again] + 1, -1)
                part = places.slice(i, j - i)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(j - i), np.asarray(part.value_lengths().fill_null(0)))
                at = r.bounds[doc] + (flat >> _SHIFT)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + (flat & ((1 << _SHIFT) - 1)), -1)
                gone = np.cumsum(cover[:-1]) > 0
                here = data[offsets[i] : offsets[j]]
                cuts = offsets[i : j + 1] - offsets[i]
                ends = np.append(r.starts, len(here))[1:]
                tail = r.bounds[1:][r.bounds[1:] > r.bounds[:-1]] - 1
                ends[tail] = cuts[1:][r.doc[tail]]
                change = np.zeros(len(here) + 1, np.int8)
                np.add.at(change, r.starts[gone], 1)
                np.add.at(change, ends[gone], -1)
                keep = np.cumsum(change[:-1], dtype=np.int8) == 0
                left = np.concatenate([[0], np.cumsum(keep)])[cuts]
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(here[keep].tobytes())).cast(pa.string())
                if nulls[i:j].any():
                    text = pa.compute.if_else(pa.array(~nulls[i:j]), text, pa.scalar(None, pa.string()))
                removed = np.bincount(r.doc[gone], minlength=j - i)
                out = {"text": text, "n_sentences": pa.array(np.diff(r.bounds).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64))}
                rest = [c for c in names if c not in _OWN]
                yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).slice(i, j - i) for c in rest] + list(out.values()), rest + list(out))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in _OWN]
    return docs.mapInArrow(run, ", ".join([*fields, "text string", "n_sentences long", "n_removed long"]))


def _keyed(docs: DataFrame) -> DataFrame:
    """The input's columns as c0, c1, ... (text as text), with did and row."""
    columns = [F.col(f"`{c}`").alias("text" if c == "text" else f"c{k}") for k, c in enumerate(docs.columns)]
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(did.alias("did"), F.xxhash64("doc_id", "text").alias("row"), *columns)


def _copies(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """The rows with their places; every: whether an equal row is the first of them."""
    ids = written(keyed.groupBy("did", "row").agg(F.count("*").alias("n")).filter("n > 1").select("did", "row"), "twins")
    rows = keyed.join(places, ["did", "row"], "left")
    if ids.isEmpty():
        return rows.withColumn("every", F.lit(False))
    nth = F.row_number().over(Window.partitionBy("did", "row").orderBy("did"))
    twins = rows.join(ids, ["did", "row"], "left_semi").withColumn("every", nth > 1)
    return rows.join(ids, ["did", "row"], "left_anti").withColumn("every", F.lit(False)).unionByName(twins)


def cleaned(docs: DataFrame, sentences: int = SENTENCES, min_words: int = MIN_WORDS, piece: int = PIECE) -> DataFrame:
    """Every row with its columns, the text without non-first runs, and n_sentences, n_removed under names not in use."""
    rule = (sentences, min_words, piece)
    keyed = _keyed(docs)
    found = written(spans(keyed, *rule), "spans")
    # Where ids are unique they are the order; else the row decides between texts of one id.
    tied = found.groupBy("did").agg(F.min("row").alias("one"), F.max("row").alias("two")).filter("one < two")
    place = F.col("did") if tied.isEmpty() else F.struct("did", "row")
    run = ["hash", "hash2"]
    firsts = found.groupBy(*run).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select(*run, "first")
    repeated = written(firsts, "repeated")
    hits = found.join(repeated, run).filter(place > F.col("first"))
    places = written(hits.groupBy("did", "row").agg(F.collect_set("place").alias("places")), "places")
    discard(found, repeated)
    rows = without_runs(_copies(keyed, places).drop("did", "row"), *rule)
    out = [F.col("text" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    free = lambda c: c if c not in docs.columns else f"_{c}"
    return rows.select(*out, F.col("n_sentences").alias(free("n_sentences")), F.col("n_removed").alias(free("n_removed")))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The documents with their columns; n_chars, if there, follows the text, and texts that lose all words go."""
    out = cleaned(docs)
    counts = out.columns[-2:]
    out = out.filter(F.col(counts[1]).isin(0) | (F.col(counts[1]) < F.col(counts[0])))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
