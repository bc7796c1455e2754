"""Repeated byte strings by column-wise construction of a collection's suffix order."""

from __future__ import annotations

import hashlib
import os
import tempfile
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import text_key
from fairlead.llm.minimisers import blocks, byte_grams, runs, window_minima

LENGTH, GRAM = 400, 128
# A minimiser met more often than this has its windows cut into narrower groups (see ``span_of``).
HOT = 50_000
# Bytes of strings whose suffixes are ordered together in one task.
BATCH_BYTES = 8 << 20
# Strings of hot minimisers that a task sums up before it sends them.
SUMMED = 20_000


def span_of(times: int, hot: int) -> int:
    """Places of the minimiser that windows of one string may span: the more often it is met, the fewer."""
    return 1 << 30 if times <= hot else max(1, 16 * hot // times)


class Collection:
    """The suffix order of many strings, built one byte per string and round, right to left.

    Strings are aligned on their minimisers: equal windows have the minimiser at the same place, so
    round ``r`` adds every string's byte that stands r places before its minimiser, and
    with it the window that starts there. A string enters, as a whole window, in the round of its
    last window and leaves after that of its first. Between rounds the state is on disk: the
    strings in suffix order and the common prefix of each with the one before, written and read in
    order, and the transform (the bytes in that order), to which every round adds a column.
    """

    def __init__(self, strings: list[bytes], places: list[int], length: int, folder: str):
        self.length = length
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.windows = sizes - length + 1
        self.enter = np.array(places, np.int64)
        self.leave = self.enter + self.windows
        self.order_file, self.prefix_file, self.transform_file = (
            os.path.join(folder, n) for n in ("order", "prefixes", "transform"))

    def start(self, which: np.ndarray, turn: int) -> np.ndarray:
        """Where in ``data`` the windows of this round begin."""
        return self.begin[which] + self.windows[which] - 1 - (turn - self.enter[which])

    def prefixes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of windows beginning at a and at b."""
        out = np.empty(len(a), np.int16)
        span = np.arange(self.length)
        for i in range(0, len(a), 4096):
            other = self.data[a[i:i + 4096, None] + span] != self.data[b[i:i + 4096, None] + span]
            out[i:i + 4096] = np.where(other.any(axis=1), other.argmax(axis=1), self.length)
        return out

    def prepend(self, order: np.ndarray, prefix: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One more byte before each string that has one left."""
        stay = np.flatnonzero(self.leave[order] > turn)
        if not len(stay):
            return order[:0], prefix[:0], np.zeros(0, np.uint8)
        # Over strings that left, the common prefix of neighbours is the least between them.
        between = np.concatenate([[0], stay[:-1] + 1])
        prefix = np.minimum.reduceat(prefix[:stay[-1] + 1], between)
        order = order[stay]
        byte = self.data[self.start(order, turn)]
        by_byte = np.argsort(byte, kind="stable")
        sorted_bytes = byte[by_byte]
        prefix = np.append(prefix, 0)
        low, high = by_byte[:-1] + 1, by_byte[1:] + 1
        same = np.flatnonzero(sorted_bytes[1:] == sorted_bytes[:-1])
        new = np.zeros(len(order), np.int16)
        if len(same):
            pairs = np.column_stack([low[same], high[same]]).reshape(-1)
            least = np.minimum.reduceat(prefix, pairs)[::2]
            new[same + 1] = np.minimum(least + 1, self.length)
        return order[by_byte], new, sorted_bytes

    def enter_strings(self, order: np.ndarray, prefix: np.ndarray, fresh: np.ndarray, turn: int):
        """Put strings whose last window starts in this round into the order."""
        window = lambda s: self.data[(a := int(self.start(s, turn))):a + self.length].tobytes()
        texts = sorted((window(s), int(s)) for s in fresh)
        at = np.array([bisect_left(order, t, key=window) for t, _ in texts], np.int64)
        order = np.insert(order, at, [s for _, s in texts])
        prefix = np.insert(prefix, at, 0)
        put = at + np.arange(len(at))
        touched = np.unique(np.concatenate([put, put + 1]))
        touched = touched[(touched > 0) & (touched < len(order))]
        starts = self.start(order, turn)
        prefix[touched] = self.prefixes(starts[touched - 1], starts[touched])
        prefix[0] = 0
        return order, prefix

    def repeated(self, weights: np.ndarray) -> list[np.ndarray]:
        """Per string, for each of its windows: does the window occur twice or more in the collection?"""
        base = np.cumsum(self.windows) - self.windows
        flags = np.zeros(int(self.windows.sum()), bool)
        entering = np.argsort(self.enter, kind="stable")
        turns = self.enter[entering]
        np.zeros(0, np.int64).tofile(self.order_file)
        np.zeros(0, np.int16).tofile(self.prefix_file)
        turn, last = int(self.enter.min()), int(self.leave.max())
        with open(self.transform_file, "wb") as transform:
            while turn < last:
                order = np.fromfile(self.order_file, np.int64)
                prefix = np.fromfile(self.prefix_file, np.int16)
                order, prefix, column = self.prepend(order, prefix, turn)
                column.tofile(transform)
                fresh = entering[np.searchsorted(turns, turn):np.searchsorted(turns, turn, "right")]
                if len(fresh):
                    order, prefix = self.enter_strings(order, prefix, fresh, turn)
                if len(order):
                    kind = np.cumsum(prefix < self.length) - 1
                    often = np.bincount(kind, weights[order]) >= 2
                    flags[base[order] + self.start(order, turn) - self.begin[order]] = often[kind]
                order.tofile(self.order_file)
                prefix.tofile(self.prefix_file)
                later = np.searchsorted(turns, turn, "right")
                turn = turn + 1 if len(order) or later == len(turns) else max(turn + 1, int(turns[later]))
        return np.split(flags, base[1:])


def repeated_windows(strings: list[bytes], weights: list[int], places: list[int], length: int) -> list[np.ndarray]:
    """``Collection.repeated`` with its files in a folder of the task, which is removed at the end."""
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        return Collection(strings, places, length, folder).repeated(np.array(weights, np.float64))


def _minimisers(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            n = np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column(1)):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                if len(data) < length:
                    continue
                h, width = byte_grams(data, gram), length - gram + 1
                least = window_minima(h, width)
                parts = runs(least)
                met = least[[a for a, _ in parts]]
                # In a periodic text one run meets its minimiser more than once.
                values.append(met)
                times.append(np.array([np.count_nonzero(h[a:b - 1 + width] == least[a]) for a, b in parts], np.int64))
                n[row] = len(met)
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values).view(np.int64)), batch.column(0).take(at), pa.array(np.concatenate(times))],
                names=["m", "tk", "n"])

    return run


def _strings(length: int, gram: int, hot: int):
    """Strings of windows that share a shared minimiser: (bucket, h, packed, place, times, tk, starts).

    Copies of a text stand together and give their strings once, with their number; only a text without copies
    gives tk and starts, as copies are removed whole. A string that a text holds many times, as periodic ones do, is one row
    with all its starts. Equal strings of hot minimisers are summed up
    before they travel; the rows that tell where they stand then carry no string.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict[tuple[int, int, bytes, int], int] = {}
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                              names=["bucket", "h", "packed", "place", "times", "tk", "starts"])

        def flush():
            rows = [(*key, times, None, None) for key, times in summed.items()]
            summed.clear()
            return batch_of(list(zip(*rows)) if rows else [[]] * 7)

        def add(rows, raw, tk, shared, number, copies):
            data = np.frombuffer(raw, np.uint8)
            h = byte_grams(data, gram)
            least = window_minima(h, length - gram + 1)
            times = dict(zip(shared.values.field("m").to_pylist(), shared.values.field("n").to_pylist()))
            signed = least.view(np.int64)
            own: dict[tuple[int, int], list] = {}
            for a, b in runs(least):
                m = int(signed[a])
                if m not in times:
                    continue
                span = span_of(times[m], hot)
                for x, y, place in blocks(h, least[a], a, b, length - gram + 1, span):
                    packed, key = raw[x:y - 1 + length], m
                    name = xxhash.xxh64_intdigest(packed) - (1 << 63)
                    if times[m] > hot:  # every window of this block of places holds these bytes
                        at, low = y - 1 + place, place // span * span
                        key = xxhash.xxh64_intdigest(raw[at - low:at - low - span + 1 + length]) - (1 << 63)
                        summed[key, name, packed, place] = summed.get((key, name, packed, place), 0) + number
                        if copies > 1:
                            continue
                        packed = None
                    row = own.setdefault((key, name), [key, name, packed, place, 0, None if copies > 1 else tk, []])
                    row[4] += number
                    row[6].append(x)
            for row in own.values():
                for column, value in zip(rows, row):
                    column.append(value)

        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            tks, copies = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            at = 0
            while at < len(tks):
                stop = at + 1
                while stop < len(tks) and tks[stop] == tks[at]:
                    stop += 1
                add(rows, batch.column(1)[at].as_py(), tks[at], batch.column(2)[at], stop - at, copies[at])
                at = stop
            yield batch_of(rows)
            if len(summed) > SUMMED:
                yield flush()
        yield flush()

    return run


def _judge(length: int):
    """Strings (bucket, h, packed, place, times) sorted by bucket in; (bucket, h, spans) out, runs [from, to) of repeated windows."""
    def found(groups: list[tuple[int, dict]]) -> list[tuple]:
        flags: list[tuple] = []
        several = [(bucket, packed, *row) for bucket, g in groups if len(g) > 1 for packed, row in g.items()]
        if several:
            judged = repeated_windows([r[1] for r in several], [r[4] for r in several], [r[3] for r in several], length)
            flags += [(row[0], row[2], f) for row, f in zip(several, judged)]
        # A string alone in its bucket shares windows with its own copies or with nothing.
        flags += [(bucket, h, np.ones(len(packed) - length + 1, bool))
                  for bucket, g in groups if len(g) == 1 for packed, (h, _, times) in g.items() if times > 1]
        return [(bucket, h, [{"a": a, "b": b} for a, b in runs(f) if f[a]]) for bucket, h, f in flags if f.any()]

    def batch_of(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
             pa.array([r[2] for r in out], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            names=["bucket", "h", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size = [], 0
        for batch in batches:
            for bucket, h, packed, place, times in zip(*(c.to_pylist() for c in batch.columns)):
                if not groups or groups[-1][0] != bucket:
                    if size > BATCH_BYTES:
                        yield batch_of(found(groups))
                        groups, size = [], 0
                    groups.append((bucket, {}))
                had = groups[-1][1].get(packed)
                size += 0 if had else len(packed)
                groups[-1][1][packed] = (h, place, times + (had[2] if had else 0))
        yield batch_of(found(groups))

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(tk, whole, spans): which windows of each distinct text start more than once in the corpus.

    ``texts`` has tk (a text's 128-bit key) and text (bytes). ``whole``: the text itself occurs more than once,
    so everything long enough is repeated; else spans are runs [a, b) of window starts.
    """
    copies = texts.groupBy("tk").agg(F.count(F.lit(1)).alias("copies"))
    met = texts.select("tk", "text").mapInArrow(_minimisers(length, gram), "m long, tk binary, n long")
    shared = met.groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1")
    hits = met.join(shared.withColumnRenamed("n", "times"), "m").groupBy("tk").agg(
        F.collect_set(F.struct("m", F.col("times").alias("n"))).alias("shared")).join(copies, "tk")
    # Sorted by text key, so copies stand together.
    strings = texts.join(hits.hint("merge"), "tk").select("tk", "text", "shared", "copies").mapInArrow(
        _strings(length, gram, hot),
        "bucket long, h long, packed binary, place int, times long, tk binary, starts array<int>")
    judged = strings.filter("packed is not null").select("bucket", "h", "packed", "place", "times").repartition(
        "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(length), "bucket long, h long, spans array<struct<a:int,b:int>>")
    places = strings.filter("tk is not null").select("tk", "bucket", "h", "starts")
    here = F.flatten(F.transform("starts", lambda x: F.transform(
        "spans", lambda s: F.struct((s["a"] + x).alias("a"), (s["b"] + x).alias("b")))))
    spans = places.join(judged, ["bucket", "h"]).select("tk", here.alias("spans")).groupBy("tk").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))
    return copies.join(spans, "tk", "left").filter("copies > 1 or spans is not null").select(
        "tk", (F.col("copies") > 1).alias("whole"), "spans")


def cover(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [from, to) covered by windows starting in the given runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b - 1 + length)
        else:
            out.append((a, b - 1 + length))
    return out


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    One row per input row: doc_id, n_bytes, n_removed, spans (maximal removed runs [a, b) of bytes), kept
    (the remaining bytes), kept_sha256. Strings are judged on the input and never cross documents. A
    null text counts as empty and loses nothing, as does any text shorter than ``length``. Repeated
    rows are copies of each other, so they lose everything. Null ids stay; other columns are left out; an
    empty table gives no row.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    marks = repeated_spans(texts, length, gram, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text, whole, spans in zip(*(c.to_pylist() for c in batch.columns[1:])):
                gone = []
                if whole and len(text) >= length:
                    gone = [(0, len(text))]
                elif spans and not whole:
                    gone = cover([(s["a"], s["b"]) for s in spans], length)
                edges = [0, *(x for g in gone for x in g), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(rows, (len(text), len(text) - len(kept), [{"a": a, "b": b} for a, b in gone],
                                                kept, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds))],
                                             names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return texts.join(marks, "tk", "left").select("doc_id", "text", "whole", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, spans array<struct<a:bigint,b:bigint>>, kept binary, kept_sha256 string")
