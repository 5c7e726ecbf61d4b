"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features are hashes of words and of their shapes (case, first and last byte, length class, whether the
word before is the same), one and two at a time, in 2 ** BITS slots; a feature's value is its share of
the text's n-grams times ``SCALE``.  A score is the logistic of the dot product of these with the
weights.  Texts are read whole.

Training takes a bounded sample (``ROWS`` texts of each label, of at most ``MAX_CHARS``
characters; rare labels weigh what they weigh in the labels) and runs on the driver, one text at a
time with per-coordinate rates.  Null and empty texts score by the bias alone.  Without labels all
score 0.5.  Repeated rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .bytes import mix, words
from .bytes import utf8 as utf8_of
from .labelled import sample, scored

BITS, SCALE, ROWS, MAX_CHARS, EPOCHS = 18, 30.0, (3000, 3000), 40_000, 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.01
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot) of every n-gram, and the number of n-grams of each text."""
    w = words(data, offsets)
    here = data[offsets[0] : offsets[-1]]
    n_docs = len(offsets) - 1
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_docs)
    first, last = here[w.starts], here[w.ends - 1]
    kind = np.full(256, 4, np.uint64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    marks = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
    kind[marks] = marks
    length = np.minimum(w.ends - w.starts, 16).astype(np.uint64) >> np.uint64(2)
    follows = np.zeros(len(w.starts), bool)
    follows[1:] = w.doc[1:] == w.doc[:-1]
    same = np.zeros(len(w.starts), np.uint64)
    same[1:] = follows[1:] & (w.hashes[1:] == w.hashes[:-1])
    inner = here[np.minimum(w.starts + 1, w.ends - 1)]
    shape = mix(kind[first] + kind[last] * np.uint64(256) + kind[inner] * np.uint64(65536) + length * _C[0] + same * _C[1])
    slots, docs = [], []
    for values, salt in ((w.hashes, _C[2]), (shape, _C[3])):
        slots.append(mix(values ^ salt))
        docs.append(w.doc)
        pair = np.flatnonzero(follows)
        slots.append(mix(values[pair - 1] * _C[0] + values[pair] + salt))
        docs.append(w.doc[pair])
    doc, slot = np.concatenate(docs), (np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.int64)
    return doc, slot, np.bincount(doc, minlength=n_docs).astype(float)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of follow-the-regularised-leader on sparse rows (slots, values); slot ``size`` is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at, x = rows[i]
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * weights[i] * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weight(np.arange(size + 1))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> np.ndarray:
    """The weights, float32, the bias last."""
    got = sample(docs, labels, target, ROWS, MAX_CHARS)
    size = 1 << BITS
    y = got["label"].to_numpy().astype(float)
    if not len(y):
        return np.zeros(size + 1, np.float32)
    data, offsets = utf8_of(got["text"])
    rows = []
    for i in range(len(y)):
        _, slot, n = features(data, offsets[i : i + 2])
        at, times = np.unique(slot, return_counts=True)
        rows.append((np.append(at, size), np.append(SCALE * times / max(1.0, n[0]), 1.0)))
    share = got["total"].to_numpy() / np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum()))
    return ftrl(rows, y, share / share.mean(), size).astype(np.float32)


def scorer(weights: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, slot, n = features(data, offsets)
        total = np.bincount(doc, weights[slot].astype(float), len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(SCALE * total / np.maximum(n, 1) + float(weights[-1]), -35, 35)))

    return score


def classify(docs: DataFrame, labels: DataFrame, predict_from: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out ids are not used."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return scorer(model.value)(data, offsets)

    return scored(docs, score, predict_from)
