"""Repeated word windows by super-k-mers: windows that share a minimiser travel as one string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fairlead.llm.minimisers import blocks, runs, window_minima, word_grams, word_hashes

WINDOW, GRAM = 13, 3
# A minimiser met in more documents than this has its windows dealt singly, each by its own hash.
HOT = 50_000
# Strings a task remembers to have sent; it forgets them all when there are more.
SENT = 300_000
NEVER = (1 << 63) - 1
# Rows of answers that go out at once.
JUDGED = 20_000


class Words:
    """A text's words, their joined bytes and, per window, the minimiser."""

    def __init__(self, text: bytes | None, window: int = WINDOW, gram: int = GRAM):
        self.words = (text or b"").split()
        n = len(self.words)
        self.windows = max(0, n - window + 1)
        if self.windows:
            self.joined = b" ".join(self.words)
            ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, n) + 1) - 1
            self.starts, self.ends = np.concatenate([[0], ends[:-1] + 1]), ends
            self.hashes = word_hashes(self.joined, self.starts)
            self.grams = word_grams(self.hashes, gram)
            self.least = window_minima(self.grams, window - gram + 1)

    def string(self, start: int, stop: int, window: int) -> bytes:
        """The words of windows start .. stop-1."""
        return self.joined[self.starts[start]:self.ends[stop + window - 2]]


def order_key() -> list[Column]:
    """Columns that name a row by document and text: o (a null doc_id comes after all others) and tk."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NEVER)).alias("o"), F.xxhash64(text, F.lit(7)).alias("tk")]


def _minimisers(window: int, gram: int):
    """Per row its runs of windows that share a minimiser: (m, h, o, tk), h a hash of the run's string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minimisers, strings = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            n = np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column(2)):
                w = Words(text.as_py(), window, gram)
                if not w.windows:
                    continue
                parts = np.array(runs(w.least))
                spans = zip(w.starts[parts[:, 0]].tolist(), w.ends[parts[:, 1] + window - 2].tolist())
                strings.append(np.fromiter((xxhash.xxh64_intdigest(w.joined[a:b]) for a, b in spans), np.uint64, len(parts)))
                minimisers.append(w.least[parts[:, 0]])
                n[row] = len(parts)
            at = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(minimisers).view(np.int64)), pa.array(np.concatenate(strings).view(np.int64)),
                 batch.column(0).take(at), batch.column(1).take(at)], names=["m", "h", "o", "tk"])

    return run


def _strings(window: int, gram: int):
    """Per row its shared super-k-mers: (bucket, packed, o, tk, starts).

    A string that is the same wherever its minimiser occurs is judged already: it belongs to the least
    document, which this row is not. So is one that the task has sent from a smaller document. The runs
    of windows judged here go in one row without a string, as first and last + 1 in turn. All other strings travel,
    those that a row holds more than once with all their starts.
    """
    kinds_of = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for batch in batches:
            out = []
            texts = batch.column(2).field("text")
            for o, tk, text, uniform, other, hot in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, *(c.to_pylist() for c in batch.columns[3:])):
                w = Words(text.as_py().encode(), window, gram)
                kinds = {**dict.fromkeys(other, 1), **dict.fromkeys(hot, 2), **dict.fromkeys(uniform, 0)}
                least = w.least.view(np.int64)
                judged, own = [], {}
                for a, b in runs(w.least):
                    m = int(least[a])
                    kind = kinds.get(m)
                    if kind is None:
                        continue
                    if kind == 0:
                        judged += (a, b)
                        continue
                    for x, y, _ in blocks(w.grams, w.least[a], a, b, window - gram + 1, 1) if kind == 2 else [(a, b, 0)]:
                        packed = w.string(x, y, window)
                        h = xxhash.xxh64_intdigest(packed) - (1 << 63)
                        if sent.get((m, h), o) < o:
                            judged += (x, y)
                        elif (m, h) in own:
                            own[m, h][-1].append(x)
                        else:
                            own[m, h] = [h if kind == 2 else m, packed, o, tk, [x]]
                if judged:
                    out.append((tk, None, o, tk, judged))
                out += own.values()
                if len(sent) > SENT:
                    sent.clear()
                sent.update(dict.fromkeys(own, o))
            columns = zip(*out) if out else [[]] * len(kinds_of)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of)],
                                             names=["bucket", "packed", "o", "tk", "starts"])

    return run


def later_runs(rows: Iterable[tuple[bytes, int, int, list[int]]], window: int) -> Iterator[tuple[int, int, list[int]]]:
    """(o, tk, spans): the windows of a bucket's strings that an earlier owner holds too, as runs' first and last + 1 in turn.

    ``rows`` are (packed, o, tk, starts) in order of o, so whoever brings a window first has its least owner. Different strings
    and, once there are two, their windows are held; rows are not.
    """
    strings: dict[bytes, int] = {}
    seen: dict[bytes, int] = {}

    def firsts(packed: bytes, o: int) -> list[int]:
        words = packed.split(b" ")
        return [seen.setdefault(b" ".join(words[i:i + window]), o) for i in range(len(words) - window + 1)]

    for packed, o, tk, starts in rows:
        if packed is None:  # judged where it was read
            yield o, tk, starts
            continue
        first = strings.setdefault(packed, o)
        if first < o:
            found = [(0, packed.count(b" ") + 2 - window)]
        elif len(strings) == 1:
            continue
        else:
            if not seen:
                firsts(*next(iter(strings.items())))
            later = np.array(firsts(packed, o)) < o
            found = [(a, b) for a, b in runs(later) if later[a]]
        if found:
            yield o, tk, [x + end for x in starts for span in found for end in span]


def _judge(window: int):
    """Rows (bucket, packed, o, tk, starts) sorted by bucket and o in, (o, tk, spans) out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        found = chain.from_iterable(later_runs((r[1:] for r in bucket), window) for _, bucket in groupby(rows, key=lambda r: r[0]))
        while part := list(islice(found, JUDGED)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*part), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["o", "tk", "spans"])

    return run


def later_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(o, tk, spans): per row its runs of windows that also start in a row of smaller ``o``, as first and last + 1 in turn.

    ``rows`` has o, tk and row, a struct with ``text``. Minimisers of all windows meet
    first, as numbers, with a 64-bit hash of the string of windows that share them. Only minimisers of two documents
    matter. If all their strings are equal, every window belongs to the least document and the row
    can tell by itself what it loses. Otherwise the strings travel to the minimiser's bucket with their places, save those
    that their task has sent from a smaller document, so that a passage in many documents is a few rows per task.
    """
    texts = rows.select("o", "tk", F.col("row.text").cast("binary").alias("text"))
    met = texts.mapInArrow(_minimisers(window, gram), "m long, h long, o long, tk long")
    over = lambda c: c.over(W.partitionBy("m"))
    shared = met.select("m", "o", "tk", over(F.min("o")).alias("lo"), over(F.max("o")).alias("hi"), over(F.min("h")).alias("h0"),
                        over(F.max("h")).alias("h1"), over(F.count(F.lit(1))).alias("n")).filter("lo < hi")
    kind = F.when(F.col("h0") == F.col("h1"), 0).when(F.col("n") <= hot, 1).otherwise(2)
    some = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("m")))
    hits = shared.withColumn("kind", kind).filter("kind > 0 or lo < o").groupBy("o", "tk").agg(
        some(0).alias("uniform"), some(1).alias("other"), some(2).alias("hot"))
    strings = rows.join(hits, ["o", "tk"]).select("o", "tk", "row", "uniform", "other", "hot").mapInArrow(
        _strings(window, gram), "bucket long, packed binary, o long, tk long, starts array<int>")
    judged = strings.repartition("bucket").sortWithinPartitions("bucket", "o").mapInArrow(
        _judge(window), "o long, tk long, spans array<int>")
    return judged.groupBy("o", "tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_words(text: bytes, spans: np.ndarray | None, window: int) -> tuple[int, int, bytes]:
    """(words, removed words, the others joined by one blank) without the words of windows in ``spans``."""
    words = text.split()
    if spans is None:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, spans[::2], 1)
    np.add.at(edge, spans[1::2] - 1 + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Remove every word of a window of ``window`` words that also starts in a document of smaller doc_id.

    One row per input row: ``row`` (all columns as they came), n_words, n_removed, kept (the words
    left, joined by one blank), kept_sha256. Windows are judged on the input. Words are runs of
    non-blank characters, unchanged; a null text has none; a text of fewer words than a window loses
    nothing. Null ids come after all others and not before each other. Repeated rows and equal ids
    do not count as smaller. Columns of any name are kept inside ``row``; an empty table gives no row.
    """
    rows = docs.select(*order_key(), F.struct(*docs.columns).alias("row"))
    marks = later_windows(rows, window, gram, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(batch.column(0).field("text"), batch.column(1)):
                at = np.asarray(spans.values.to_numpy(zero_copy_only=False), np.int64) if spans.is_valid else None
                n, gone, kept = kept_words((text.as_py() or "").encode(), at, window)
                made.append((n, gone, kept.decode(), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "n_words", "n_removed", "kept", "kept_sha256"])

    joined = rows.join(marks, ["o", "tk"], "left").select("row", "spans")
    schema = StructType([rows.schema["row"], *(StructField(n, k) for n, k in (
        ("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType()), ("kept_sha256", StringType())))])
    return joined.mapInArrow(run, schema)
