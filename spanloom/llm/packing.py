"""Variable-capacity best-fit packing of documents into sequences.

Documents are cut into pieces of at most the largest permitted length and dealt into blocks of about
``block_rows`` documents; each block is packed in one task (a block is bounded by that parameter, not by the
data).  A sequence of length c costs ``overhead + c + c * c / quadratic``: a fixed part, its tokens, and
attention, which grows with the square.

Within a block the longest piece goes first, into the open bin it leaves least room in.  If none has room, a
new bin opens at the permitted length of least cost: for each length the fill that the pieces still to come can
give it is worked out, and the length whose cost for each token of that fill is least is opened, counting
the bin at the length it would shrink to.  So all lengths are weighed together by what is left for them.  At the
end each bin shrinks to the smallest permitted length that holds its contents.  A block is also packed with every
prefix of the permitted lengths that can hold its longest piece, and the cheapest packing is taken, so it never costs
more than best-fit with the largest length alone.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import n_words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD, QUADRATIC = 64.0, 16_384.0
SCHEMA = "doc_id long, piece int, n_tokens long, bin_id long, bin_size int, bin_offset int"

Packing = tuple[list[int], list[int], list[int]]


def cost(size: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + size + size * size / quadratic


def total_cost(sizes: list[int], overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return sum(cost(c, overhead, quadratic) for c in sizes)


class Left:
    """How many pieces of each length are still to come, lengths in order."""

    def __init__(self, lengths: list[int]):
        self.lengths = sorted(set(lengths))
        self.times = dict.fromkeys(self.lengths, 0)
        for n in lengths:
            self.times[n] += 1

    def take(self, n: int) -> None:
        self.times[n] -= 1
        if not self.times[n]:
            del self.lengths[bisect_left(self.lengths, n)]

    def fill(self, room: int) -> int:
        """Tokens that a room holds when the longest piece that fits goes first."""
        held = 0
        at = bisect_right(self.lengths, room)
        while at and self.lengths[0] <= room:
            n = self.lengths[at - 1]
            times = min(self.times[n], room // n)
            held += times * n
            room -= times * n
            at = bisect_right(self.lengths, room, 0, at - 1)
        return held


def _pack(order: list[int], lengths: list[int], sizes: list[int], overhead: float, quadratic: float, joint: bool) -> Packing:
    """Best-fit in ``order``; a new bin has the largest size, or with ``joint`` that of least cost for its fill."""
    room: list[tuple[int, int]] = []  # (room left, bin), ordered
    used: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    to_come = Left(lengths) if joint else None
    for i in order:
        need = lengths[i]
        if to_come:
            to_come.take(need)
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left = sizes[-1]
            if to_come:
                best = None
                for c in sizes[bisect_left(sizes, need) :]:
                    held = need + to_come.fill(c - need)
                    shrunk = sizes[bisect_left(sizes, held)]
                    value = (cost(shrunk, overhead, quadratic) / held, c)
                    if best is None or value < best:
                        best = value
                left = best[1]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
        if left > need:
            insort(room, (left - need, b))
    return bins, offsets, [sizes[bisect_left(sizes, u)] for u in used]


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> Packing:
    """Bin and offset of each length (0 < length <= the largest capacity), and the final bin sizes."""
    if not lengths:
        return [], [], []
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    upto = [sizes[: k + 1] for k in range(bisect_left(sizes, max(lengths)), len(sizes))]
    found = [_pack(order, lengths, part, overhead, quadratic, joint) for part in upto for joint in (True, False)]
    return min(found, key=lambda p: (total_cost(p[2], overhead, quadratic), len(p[2])))


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC, block_rows: int = 2048) -> DataFrame:
    """A row for each piece: doc_id, piece, n_tokens, bin_id, bin_size, bin_offset.

    A token is a word ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts keep one row of 0 tokens without a
    bin; repeated rows are packed as documents of their own and dealt to blocks like others; so are null ids; an empty
    table gives an empty result; other columns are not read.
    """
    # Written once with a number of its own for each row, so that blocks are the same whenever a task runs again.
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), n_words(F.col("text")).alias("n_tokens"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows, "lengths")
    blocks = max(1, math.ceil(rows.count() / block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    top = max(capacities)

    def pack(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["n_tokens", "no_id", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
        ids, pieces, sizes, none = [], [], [], []
        for doc, no_id, n in zip(block["doc_id"].tolist(), block["no_id"].tolist(), block["n_tokens"].tolist(), strict=True):
            doc = None if no_id else doc
            if not n:
                none.append(doc)
            for k in range(math.ceil(n / top)):
                ids.append(doc)
                pieces.append(k)
                sizes.append(min(top, n - k * top))
        bins, offsets, final = best_fit(sizes, capacities, overhead, quadratic)
        first = int(key[0]) << 32
        out = pd.DataFrame(
            {
                "doc_id": pd.array(ids + none, dtype="Int64"),
                "piece": pieces + [0] * len(none),
                "n_tokens": sizes + [0] * len(none),
                "bin_id": pd.array([first + b for b in bins] + [None] * len(none), dtype="Int64"),
                "bin_size": pd.array([final[b] for b in bins] + [None] * len(none), dtype="Int32"),
                "bin_offset": pd.array(offsets + [None] * len(none), dtype="Int32"),
            }
        )
        return out.astype({"piece": "int32", "n_tokens": "int64"})

    return rows.groupBy("block").applyInPandas(pack, SCHEMA)
