"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.minimisers import PLACE, mix

Q, EDIT_SHARE = 8, 0.08
# Characters of benchmark items that one pass over the documents carries. Larger benchmarks take several.
BLOCK_CHARS = 4_000_000
PIECE_CHARS = 400_000
SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return SPACE.sub(" ", (text or "").lower()).strip()


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number per run of q characters."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    h, width, out, done = points.astype(np.uint64), 1, None, 0
    while width <= q:  # hashes of one, two, four .. characters; those that make up q are joined
        if q & width:
            out = h if out is None else out[:len(out) - width] * PLACE[width] + h[done:]
            done += width
        if 2 * width <= q:
            h = h[:-width] * PLACE[64 + width] + h[width:]
        width *= 2
    return mix(out[:len(points) - q + 1])


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(length: int, q: int, share: float) -> int:
    """Edits allowed in an item: a share of its length, and few enough that a match must share a q-gram."""
    return max(0, min(int(share * length), (length - q) // q))


class Index:
    """The q-grams of a block of items, in one sorted list behind a small bitmap."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float):
        self.q, self.items = q, [(i, normal(t)) for i, t in items]
        self.items = [(i, t) for i, t in self.items if t]
        self.points = [points_of(t) for _, t in self.items]
        self.edits = [budget(len(p), q, share) for p in self.points]
        made = [grams(p, q) for p in self.points]
        owner = np.repeat(np.arange(len(made)), [len(m) for m in made])
        place = np.concatenate([np.arange(len(m)) for m in made] or [np.zeros(0, np.int64)])
        number = np.concatenate(made or [np.zeros(0, np.uint64)])
        order = np.argsort(number, kind="stable")
        self.number, self.owner, self.place = number[order], owner[order], place[order]
        self.bits = max(16, int(2 * max(len(number), 1)).bit_length() + 4)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(self.number >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.need = np.array([max(1, len(p) + 1 - q * (e + 1)) for p, e in zip(self.points, self.edits)], np.int64)
        self.reach = max((len(p) for p in self.points), default=0)
        self.short = [(k, t) for k, (_, t) in enumerate(self.items) if len(self.points[k]) < q]

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the text) of all common q-grams."""
        h = grams(points, self.q)
        at = np.flatnonzero(self.map[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        low = np.searchsorted(self.number, h[at], "left")
        count = np.searchsorted(self.number, h[at], "right") - low
        total = int(count.sum())
        index = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)
        return self.owner[index], self.place[index], np.repeat(at, count)


def banded_distance(item: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> tuple[int, int, int]:
    """(edits, from, to) of the item's best place in the text within a band of diagonals.

    The band covers diagonals first .. first+width-1, a diagonal being place in the text minus place in the
    item. Row by row; more than ``most`` edits are given as most + 1.
    """
    diagonals = np.arange(width)
    base = first + diagonals
    outside = most + 1
    # Row 0: the match may begin at any place of the text in the band.
    cost = np.where((base >= 0) & (base <= len(text)), 0, outside)
    start = base.copy()
    for i in range(1, len(item) + 1):
        at = base + i  # characters of the text used on each diagonal
        inside = (at >= 1) & (at <= len(text))
        char = text[np.clip(at - 1, 0, max(len(text) - 1, 0))] if len(text) else np.zeros(width, item.dtype)
        new = np.where(inside, cost + (char != item[i - 1]), outside)
        begun = start.copy()
        up = np.append(cost[1:] + 1, outside)  # a character of the item is missing in the text
        better = (up < new) & (at >= 0) & (at <= len(text))
        new, begun = np.where(better, up, new), np.where(better, np.append(start[1:], 0), begun)
        # Extra characters of the text move to higher diagonals, one edit each.
        shifted = new - diagonals
        least = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == least, diagonals, 0))
        moved = (least + diagonals < new) & inside
        new, begun = np.where(moved, least + diagonals, new), np.where(moved, begun[source], begun)
        cost, start = np.minimum(new, outside), begun
        if cost.min() > most:
            return outside, 0, 0
    end = base + len(item)
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), int(end[best])


def matches(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item, edits, from, to) of items found in a normalised text, the best place of each.

    By the q-gram lemma a match of an item of m characters with at most e edits shares at least
    m + 1 - q(e + 1) of its q-grams, all within e + 1 neighbouring diagonals. Diagonals are
    counted in bands of 2(e + 1) that overlap by half, so some band holds all of them; a band is kept
    if, within a stretch of text no longer than the item and its edits, it reaches the number. Only
    kept regions are aligned.
    """
    found: dict[int, tuple[int, int, int]] = {}
    points, reach = points_of(text), index.reach
    for begin in range(0, max(len(points), 1), PIECE_CHARS):  # long texts in overlapping stretches
        part = points[begin:begin + PIECE_CHARS + 2 * reach + index.q]
        item, place, at = index.hits(part)
        if not len(item):
            continue
        enough = np.bincount(item, minlength=len(index.need)) >= index.need
        keep = np.flatnonzero(enough[item])
        if not len(keep):
            continue
        keep = keep[np.argsort(item[keep], kind="stable")]
        item, place, at = item[keep], place[keep], at[keep]
        edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            k = int(item[a])
            m, e = len(index.points[k]), index.edits[k]
            need = int(index.need[k])
            if found.get(k, (e + 1, 0, 0))[0] == 0:
                continue
            if (exact := text.find(index.items[k][1])) >= 0:  # no edits: nothing to align
                found[k] = 0, exact, exact + m
                continue
            diagonal, half = at[a:b] - place[a:b], e + 1
            for shift in (0, half):  # overlapping bands: those that begin at even and at odd multiples
                band = (diagonal + shift) // (2 * half)
                order = np.lexsort((at[a:b], band))
                there, pos = band[order], at[a:b][order]
                if len(pos) < need:
                    continue
                last = np.arange(need - 1, len(pos))
                close = (there[last] == there[last - need + 1]) & (pos[last] - pos[last - need + 1] <= m + e)
                for h in np.unique(there[last[close]]).tolist():
                    lowest = h * 2 * half - shift
                    got = banded_distance(index.points[k], part, lowest - e, 2 * half + 2 * e, e)
                    if got[0] <= e and got[0] < found.get(k, (e + 1, 0, 0))[0]:
                        found[k] = got[0], begin + got[1], begin + got[2]
    out = [(index.items[k][0], *v) for k, v in found.items()]
    out += [(index.items[k][0], 0, place, place + len(t)) for k, t in index.short
            if (place := f" {text} ".find(f" {t} ")) >= 0]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, read one block after another."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.char_length("text"))).head()[0] or 0
    n = max(1, -(-2 * total // block_chars))
    for part in range(n):
        yield [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == part).distinct().collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, leaks): every input row in a struct, with the benchmark items its text holds.

    leaks lists (item_id, edits, start, length) per item: its best place in the text after lower-casing
    and joining white space, with at most ``share`` of the item's characters edited. Texts are read whole. Items
    shorter than q characters must occur as whole words. Null and blank items match nothing, null and
    empty texts hold nothing, repeated items count once, rows of any id and repeated rows stay; with
    an empty benchmark every list is empty.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"),
                       F.expr("cast(array() as array<struct<item_id:bigint,edits:int,start:bigint,length:bigint>>)").alias("leaks"))
    schema = rows.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
    for items in item_blocks(benchmark, block_chars):
        index = Index(items, q, share)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = []
                for text, had in zip(batch.column(1), batch.column(2).to_pylist()):
                    now = matches(index, normal(text.as_py()))
                    leaks.append((had or []) + [
                        {"item_id": i, "edits": e, "start": a, "length": b - a} for i, e, a, b in now])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaks, kind)],
                                                 names=["row", "text", "leaks"])

        rows = rows.mapInArrow(run, schema)
    return rows.select("row", "leaks")
