"""Best-fit-decreasing packing of pieces into sequences of fixed capacity, over counts of lengths."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import number_within, written
from fairlead.llm.tokens import token_pieces


class CapacityTree:
    """Segment tree over remaining capacities 0..top; finds the least open one that is large enough."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.leaves
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """The least open capacity of at least ``need``, in logarithmic time."""
        node = need + self.leaves
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Places for ``counts[length]`` pieces of each length, and the number of bins.

    Lengths are taken in falling order and each piece goes to the tightest open bin, exactly as
    best-fit decreasing does piece by piece. Bins alike in remaining capacity are kept as ranges
    of bin numbers, so a step places a whole range at once and the plan's size depends on the
    capacity alone, never on the number of pieces. A plan row (length, rank, n, bin, offset) puts
    the pieces of that length numbered rank, rank+1, .. into bins bin, bin+1, .. at that offset.
    """
    tree, free, bins, rows = CapacityTree(capacity), {}, 0, []

    def release(room: int, start: int, n: int) -> None:
        if room and n:
            free.setdefault(room, []).append((start, n))
            tree.set(room, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit capacity {capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, start, there = capacity, bins, -(-left // (capacity // length))
                bins += there
            else:
                start, there = free[room].pop()
                if not free[room]:
                    tree.set(room, False)
            each = room // length  # the bin just used stays the tightest while it has room
            full = min(there, left // each)
            for turn in range(each if full else 0):
                rows.append((length, rank, full, start, capacity - room + turn * length))
                rank += full
            left -= full * each
            release(room - each * length, start, full)
            if full < there and left:  # fewer pieces left than one more bin takes
                for turn in range(left):
                    rows.append((length, rank, 1, start + full, capacity - room + turn * length))
                    rank += 1
                release(room - left * length, start + full, 1)
                left, full = 0, full + 1
            release(room, start + full, there - full)
    return pd.DataFrame(rows, columns=["length", "rank", "n", "bin", "offset"]), bins


def place(pieces: DataFrame, capacity: int, order: Iterable[str] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``.

    Only a count per length reaches the driver: at most ``capacity`` numbers. Pieces of one
    length are numbered over all tasks, and a number finds its place in the plan by binary search.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan, _ = best_fit_plan(counts, capacity)
    shift = 44
    key = (plan["length"].to_numpy(np.int64) << shift) + plan["rank"].to_numpy(np.int64)
    order_of = np.argsort(key)
    key = key[order_of]
    first, rank, offset = (plan[c].to_numpy(np.int64)[order_of] for c in ("bin", "rank", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        x = number.to_numpy(np.int64)
        at = np.searchsorted(key, (length.to_numpy(np.int64) << shift) + x, "right") - 1
        return pd.DataFrame({"sequence_id": first[at] + x - rank[at], "offset": offset[at]})

    numbered = number_within(pieces, ["length"], list(order), "_number", sum(counts.values()))
    placed = numbered.withColumn("_place", look_up("length", "_number"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Best-fit packing of whole documents into as few sequences of ``capacity`` ids as it finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents
    longer than the capacity are cut. Null texts count as empty (one end id); null ids, ties and
    repeated rows each keep a row and a place; an empty table gives no row; other columns are left out.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return place(pieces, capacity)
