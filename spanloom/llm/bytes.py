"""Words, hashes and shingles of many texts at once, straight from Arrow's UTF-8 buffers.

A word is a run of bytes other than space and U+0009..U+000D.  All arrays are for a group of whole
texts of a few MB; a longer text is a group of its own, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 4 << 20
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, i < n, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[starts[i]:ends[i]] for each i, whatever stands before it."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    starts: np.ndarray  # byte offsets into the group's data
    ends: np.ndarray
    doc: np.ndarray  # text of each word
    bounds: np.ndarray  # first word of each text, and their number
    hashes: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]; byte offsets count from offsets[0]."""
    data = data[offsets[0] : offsets[-1]]
    cuts = offsets - offsets[0]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] |= inside[1:-1][inner]
    last[inner - 1] |= inside[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + _BLOCK, "right")))
        lo = starts[k]
        hashes[k:to] = spans_hash(_BYTE[data[lo : ends[to - 1]]], starts[k:to] - lo, ends[k:to] - lo)
        k = to
    bounds = np.searchsorted(starts, cuts)
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(bounds))
    return Words(starts, ends, doc, bounds, hashes)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of k words; a shorter text that has words is one shingle."""
    starts, ends = w.bounds[:-1], w.bounds[1:]
    at = np.arange(len(w.hashes))
    full = at[at + k <= np.repeat(ends, ends - starts)]
    short = starts[(ends > starts) & (ends - starts < k)]
    lo = np.concatenate([full, short])
    hi = np.concatenate([full + k, ends[(ends > starts) & (ends - starts < k)]])
    return w.doc[lo], spans_hash(w.hashes, lo, hi)


def counted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiset of each text: (text, hash, times), ordered by text and hash."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))
