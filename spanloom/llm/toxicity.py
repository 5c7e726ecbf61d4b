"""Toxicity by two Kneser-Ney models of the bytes of words: one of toxic, one of ordinary texts.

A model gives each byte of a word, and the space behind it, a probability after up to ORDER - 1 bytes
of the same word.  Both models discount their own counts; what they set free goes to one shared model
of the lower orders, interpolated Kneser-Ney on the continuation counts of both classes together, so
a rare expression is judged by its class only as far as its class has seen it.  Letters count in lower case.

A word's evidence is the difference of its two log-likelihoods.  A toxic text is mostly ordinary words, so
a text's evidence is that of a mixture in which each word comes from the toxic model with probability
``SHARE``, plain and over the length and its root; beside it stand the mean over all words and the best mean
of ``WINDOWS`` words in a row.  A logistic curve on these and the length, fitted on labelled texts that
the counts have not seen (fold 1), turns it into a score.  No cut is set by hand.

The counts come from a bounded sample: ``ROWS`` ordinary and toxic texts of at most ``MAX_CHARS``
characters.  N-grams are counted and the fit's evidence is computed in executors; the driver gets counts of at most
sum(ROWS) * MAX_CHARS n-grams, and no text.  Scoring covers all texts, whole.  The log-ratios lie in hashed
tables as large as there are n-grams, with whole hashes, so none is lost and one that was not seen is known as
such.  Null and empty texts score 0, as do all without labels of both kinds.  Repeated rows score alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes import groups, mix
from .bytes import utf8 as utf8_of
from .labelled import sample_rows, scored
from .storage import discard, written

#: Bytes of an n-gram, Kneser-Ney's discount, prior share of toxic words in a toxic text, words of a passage.
ORDER, DISCOUNT, SHARE, WINDOWS = 8, 0.75, 0.01, (1, 4)
ROWS, MAX_CHARS = (8_000, 4_000), 20_000
_PIECE = 1 << 20  # bytes counted at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def grams(data: np.ndarray, offsets: np.ndarray, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, word) of every byte of every word, and of the space behind it: the byte and those before it in its word, spaces before the first.

    An n-gram is a number whose highest byte is the newest.
    """
    order = order or ORDER
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    here = np.full(len(text) + len(sizes), 32, np.uint8)  # a space ends every text
    here[np.arange(len(text)) + text] = _LOWER[data[offsets[0] : offsets[-1]]]
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = here != 32
    fresh = np.ones(len(here), bool)  # no byte of the word stands before
    fresh[1:] = ~inside[:-1] | (doc[1:] != doc[:-1])
    at = np.arange(len(here))
    place = at - np.maximum.accumulate(np.where(fresh, at, 0))
    code = here.astype(np.uint64) << np.uint64(8 * (order - 1))
    for back in range(1, order):
        before = np.full(len(here), 32, np.uint64)
        before[back:] = here[:-back]
        before[place < back] = 32
        code |= before << np.uint64(8 * (order - 1 - back))
    use = inside | ~fresh
    return doc[use], code[use], np.cumsum(fresh[use]) - 1


def _count(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8_of(text)
    codes, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in groups(offsets, _PIECE):
        c, t = np.unique(grams(data, offsets[i : j + 1])[1], return_counts=True)
        codes.append(c)
        times.append(t)
    return _sum(np.concatenate(codes), np.concatenate(times))


def _sum(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(codes, return_inverse=True)
    return code, np.bincount(at, times, len(code))


def _at(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.zeros(len(codes))
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, values[at], 0.0)


def _shared(codes: np.ndarray, types: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of each code's newest byte after the order - 1 bytes before it, from continuation counts of the types one order up."""
    if order == 0:
        return np.full(len(codes), 1 / 256)
    lower = np.unique(types) >> np.uint64(8)  # each type without its oldest byte
    mine, more = _sum(lower, np.ones(len(lower)))
    below = _shared(codes >> np.uint64(8), mine, order - 1)
    context = np.uint64((1 << 8 * (order - 1)) - 1)
    total, kinds = _sum(mine & context, more), _sum(mine & context, np.ones(len(mine)))
    n, k, c = _at(total, codes & context), _at(kinds, codes & context), _at((mine, more), codes)
    safe = np.maximum(n, 1)
    return np.where(n > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * k * below) / safe, below)


def log_ratios(toxic: tuple[np.ndarray, np.ndarray], ordinary: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From the (n-gram, times) of both classes: (n-gram, log toxic : ordinary) for all seen, and for their contexts the ratio of an n-gram that was not."""
    counts = [toxic, ordinary]
    seen = np.unique(np.concatenate([c for c, _ in counts]))
    context = np.uint64((1 << 8 * (ORDER - 1)) - 1)
    shared = _shared(seen >> np.uint64(8), seen, ORDER - 1)
    contexts = np.unique(seen & context)
    logs, free = [], []
    for codes, times in counts:
        total, kinds = _sum(codes & context, times), _sum(codes & context, np.ones(len(codes)))
        n, k = _at(total, seen & context), _at(kinds, seen & context)
        p = np.where(n > 0, (np.maximum(_at((codes, times), seen) - DISCOUNT, 0) + DISCOUNT * k * shared) / np.maximum(n, 1), shared)
        logs.append(np.log(p))
        n, k = _at(total, contexts), _at(kinds, contexts)
        free.append(np.log(np.where(n > 0, DISCOUNT * k / np.maximum(n, 1), 1.0)))
    return (seen, logs[0] - logs[1]), (contexts, free[0] - free[1])


def _table(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each slot of hashes begins, the hashes (of different codes different) in order, and the values; one slot or more a code."""
    h = mix(codes + np.uint64(1))
    order = np.argsort(h)
    bits = (len(codes) + 1).bit_length()
    slots = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(h[order], slots), len(codes)).astype(np.int32), h[order], values[order].astype(np.float32)


def _look(table: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, keys, values = table
    h = mix(codes + np.uint64(1))
    slot = (h >> np.uint64(65 - len(starts).bit_length())).astype(np.int64)
    at, end = starts[slot], starts[slot + 1]
    hit, value = np.zeros(len(codes), bool), np.zeros(len(codes), np.float32)
    todo = np.flatnonzero(at < end)
    at = at[todo]
    while len(todo):
        same = keys[at] == h[todo]
        hit[todo[same]], value[todo[same]] = True, values[at[same]]
        at = at + 1
        more = ~same & (at < end[todo])
        todo, at = todo[more], at[more]
    return hit, value


def evidence(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: the mixture's log-ratio, over the length and over its root; the mean of all words; the best mean of each window; log length; 1."""
    doc, code, word = grams(data, offsets)
    hit, ratio = _look(model["seen"], code)
    rest = np.flatnonzero(~hit)
    known, other = _look(model["free"], code[rest] & np.uint64((1 << 8 * (ORDER - 1)) - 1))
    ratio[rest] = np.where(known, other, 0)
    docs = len(offsets) - 1
    each = np.bincount(word, ratio.astype(float))
    doc = doc[np.flatnonzero(np.diff(word, prepend=-1))]  # of each word
    n = np.maximum(np.bincount(doc, minlength=docs), 1)
    mixed = np.bincount(doc, np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + each), docs)
    out = [mixed, mixed / n, mixed / np.sqrt(n), np.bincount(doc, each, docs) / n]
    sums, ends = np.concatenate([[0.0], np.cumsum(each)]), np.searchsorted(doc, doc, "right")
    at = np.arange(len(doc))
    for window in WINDOWS:
        best = np.full(docs, -np.inf)
        np.maximum.at(best, doc, (sums[np.minimum(at + window, ends)] - sums[at]) / window)
        out.append(np.where(np.isfinite(best), best, 0.0))
    return np.stack([*out, np.log(n), np.ones(docs)], axis=1)


def curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients of a weighted logistic regression with a weak ridge, by Newton's method with halved steps."""
    scale = np.maximum(np.sqrt((x * x).mean(axis=0)), 1e-9)
    x, ridge = x / scale, 0.05

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weights * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * beta @ beta)

    beta = np.zeros(x.shape[1])
    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (weights * (p - y)) + ridge * beta)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if before - now < 1e-8 * max(1.0, before):
            break
    return beta / scale


def counted(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of ``rows`` (text, label) and their times, of ordinary and of toxic texts; counted in executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                codes, times = _count(batch.column(0).filter(pa.array(labels == label)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), label, np.int32)), pa.array(codes.view(np.int64)), pa.array(times.astype(np.int64))], ["label", "code", "times"])

    sums = rows.select("text", "label").mapInArrow(run, "label int, code long, times long").groupBy("label", "code").agg(F.sum("times").alias("times"))
    got = sums.toArrow()
    label, code, times = (got[c].to_numpy() for c in ("label", "code", "times"))
    code = code.view(np.uint64)
    out = []
    for k in (0, 1):
        own = np.flatnonzero(label == k)
        own = own[np.argsort(code[own])]
        out.append((code[own], times[own].astype(float)))
    return out


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Broadcast:
    """The tables and the curve; None without labels of both kinds to count and to fit on."""
    context = docs.sparkSession.sparkContext
    picked = written(sample_rows(docs, labels, target, ROWS, MAX_CHARS), "labelled")
    have = {(r.fit, r.label) for r in picked.select((F.col("fold") == 1).alias("fit"), "label").distinct().collect()}
    if len(have) < 4:
        discard(picked)
        return context.broadcast(None)
    ordinary, toxic = counted(picked.filter("fold <> 1"))
    seen, free = log_ratios(toxic, ordinary)
    model = context.broadcast({"seen": _table(*seen), "free": _table(*free)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column(0))
            for i, j in groups(offsets, _PIECE):
                x = evidence(model.value, data, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(x))], ["label", "total", "x"])

    fit = picked.filter("fold = 1").select("text", "label", "total").mapInArrow(run, "label int, total long, x array<double>").collect()
    discard(picked)
    fit = sorted(fit)  # in one order, whatever the partitions
    x, y, total = np.array([r.x for r in fit]), np.array([r.label for r in fit], float), np.array([r.total for r in fit], float)
    weights = total / np.where(y == 1, y.sum(), (1 - y).sum())
    return context.broadcast(model.value | {"curve": curve(x, y, weights / weights.mean())})


def classify(docs: DataFrame, labels: DataFrame, predict_from: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out ids are not used."""
    model = train(docs, labels)

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if model.value is None:
            return np.zeros(len(offsets) - 1)
        p = 1 / (1 + np.exp(-np.clip(evidence(model.value, data, offsets) @ model.value["curve"], -35, 35)))
        return np.where(np.diff(offsets) > 0, p, 0.0)

    return scored(docs, score, predict_from)
