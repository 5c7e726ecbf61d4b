"""BagMinHash: signatures of multisets whose equal parts are a weighted Jaccard share, unbiased.

A shingle of weight w owns the axis (0, w], discretised at the integers and cut into the dyadic
blocks (0, 1], (1, 2], (2, 4], (4, 8], ...  On each block runs a Poisson process of its own, seeded by
shingle and block alone: its points have a time, a component of the signature and a place on the
block; a point counts where its place is at most w.  The earliest point of each component is the
signature.  Two multisets see the same points wherever both weights reach, so a component is equal
with probability sum(min) / sum(max).  Blocks at most double the points drawn, a process stops when
its next point is later than all that its text still needs, and a text needs about
n + m log m points for n shingles and m components.
"""

from __future__ import annotations

import numpy as np

from .bytes import mix

COMPONENTS, ROWS = 130, 5
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def signatures(doc: np.ndarray, hashes: np.ndarray, times: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """(n_docs, m) identities of the earliest points; 0 where a text has no shingle."""
    high = np.zeros(len(times), np.int64)  # the block that holds the weight
    big = times > 1
    high[big] = np.ceil(np.log2(times[big])).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), high + 1)
    first = np.cumsum(high + 1) - (high + 1)
    block = np.arange(len(at)) - first[at]
    lo = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0)).astype(np.float64)
    size = np.maximum(lo, 1.0)
    key = mix(hashes[at] ^ (block.astype(np.uint64) * _OTHER))
    row, weight = doc[at], times[at].astype(np.float64)
    time = np.zeros(len(at))
    best = np.full(n_docs * m, np.inf)
    sign = np.zeros(n_docs * m, np.uint64)
    turn = 0
    while len(row):
        turn += 1
        point = mix(key + np.uint64(turn * int(_STEP) & (1 << 64) - 1))
        other = mix(point ^ _OTHER)
        time = time - np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * m)
        slot = row * m + (((other >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        place = lo + size * (((other & np.uint64(0xFFFFFFFF)).astype(np.float64) + 1) * 2.0**-32)
        good = np.flatnonzero((np.ceil(place) <= weight) & (time < best[slot]))
        np.minimum.at(best, slot[good], time[good])
        won = good[time[good] == best[slot[good]]]
        sign[slot[won]] = point[won]
        last = best.reshape(n_docs, m).max(axis=1) if len(row) > n_docs // 4 else _last(best, row, n_docs, m)
        live = time < last[row]
        if not live.all():
            row, key, time, lo, size, weight = row[live], key[live], time[live], lo[live], size[live], weight[live]
    return sign.reshape(n_docs, m)


def _last(best: np.ndarray, row: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    out = np.zeros(n_docs)
    rows = np.unique(row)
    out[rows] = best.reshape(n_docs, m)[rows].max(axis=1)
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n_docs, m // rows) hashes of the signature's bands, each with its number."""
    n, m = sign.shape
    out = np.zeros((n, m // rows), np.uint64)
    out += np.arange(1, m // rows + 1, dtype=np.uint64)[None, :] * _STEP
    cut = sign[:, : m // rows * rows].reshape(n, m // rows, rows)
    for j in range(rows):
        out = mix(out ^ cut[:, :, j])
    return out
