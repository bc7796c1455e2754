"""Near duplicates by 64-bit similarity fingerprints, linked without listing pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import text_key, written
from fairlead.operators.graph import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Grid points with two owners are broadcast up to this many; else the join shuffles.
BROADCAST_CELLS = 50_000
BYTE_LANES, ODD = np.uint64(0x0101010101010101), np.uint64(0x5555555555555555)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bit is 1 where over half of the hashes have it."""
    n = len(hashes)
    if not n:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):  # sums of 255 one-bit lanes stay within a byte
        lanes = ((padded >> np.uint64(bit)) & BYTE_LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << (8 * byte + bit) for bit in range(8) for byte in range(8) if 2 * counts[bit, byte] > n)


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Fingerprint of all shingles of a text's lower-cased words; fewer words count as one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    return majority(np.fromiter((hashed(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, key) per row; ``key`` is the text's 128-bit key. Null texts count as empty: fp 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(1)),
                               np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), batch.column(2)],
                                             names=["doc_id", "fp", "key"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), text_key().alias("key"))
    return rows.mapInArrow(run, "doc_id long, fp long, key binary")


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid points within Manhattan distance 1 of the fingerprints' numbers of set bits in 32 segments, and whose they are, by place."""
    one, other = fps & ODD, (fps >> np.uint64(1)) & ODD
    counts, every = (one ^ other) | ((one & other) << np.uint64(1)), np.arange(len(fps))
    owners, points = [every], [counts]
    for at in range(0, 64, 2):
        value = (counts >> np.uint64(at)) & np.uint64(3)
        for some, step in ((value < 2, 1), (value > 0, 3)):  # 0 to 1, 1 to 0; 1 to 2, 2 to 1
            owners.append(every[some])
            points.append(counts[some] ^ np.uint64(step << at))
    return np.concatenate(owners), np.concatenate(points)


def flips(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and their 64 neighbours at one bit, and whose they are, by place."""
    near = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return np.repeat(np.arange(len(fps)), len(near)), (fps[:, None] ^ near).reshape(-1)


def _with(fps: DataFrame, made, name: str) -> DataFrame:
    """(fp, name): a row for every number made of a fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            owners, numbers = made(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own[owners]), pa.array(numbers.view(np.int64))], names=["fp", name])

    return fps.select("fp").mapInArrow(run, f"fp long, {name} long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` at two or fewer differing bits, and no others.

    A fingerprint becomes a point: its numbers of set bits in 32 segments. Manhattan distance
    between points is never above the number of differing bits, so only points at distance 2 or
    less matter. Two such points share a grid point within distance 1 of both; a range join over
    grid points therefore finds every fingerprint that can have a partner, with 65 rows each at
    most, however many share a cell. Segments of two bits keep chance meetings rare at any size. Those are verified in the same manner on the bits themselves: two
    fingerprints differ in at most two bits exactly if they share a neighbour within one bit, and
    such a neighbour has at most 65 owners. Its owners are linked to the least of them, so groups of
    any size give a linear number of edges and no pair within two bits stays unconnected.
    """
    placed = _with(distinct, cells, "cell")
    met = placed.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("cell")
    met = written(met, "cells")
    met = F.broadcast(met) if met.count() <= BROADCAST_CELLS else met.hint("merge")
    near = placed.join(met, "cell", "left_semi").select("fp").distinct()
    owners = _with(near, flips, "via").groupBy("via").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return owners.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b").distinct()


def rooted(docs: DataFrame, shingle: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, key) of every row, and (fp, least, root, component) of every fingerprint: root names its component."""
    rows = written(fingerprints(docs, shingle, seed), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = written(links(least.select("fp")), "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = connected_components(ends, edges).withColumnRenamed("node", "fp")
    labelled = least.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    return rows, labelled


def simhash_components(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, key, component_id): the least doc_id reachable over links of at most two bits.

    One row per input row. Words are runs of non-blank bytes after lower-casing A to Z; a text of fewer
    words than a shingle is one shingle; null, empty and blank texts have fingerprint 0, which
    links like any other. Null ids never become a component's id unless it has no other. Repeated
    rows stay. An empty table gives no row. Only distinct fingerprints are linked, so copies cost nothing.
    """
    rows, labelled = rooted(docs, shingle, seed)
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.join(smallest, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "key", "component_id")


def one_per_component(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The documents with one row of each ``component_id`` kept: the least id, then the least text key.

    Equal rows of the kept id and text stay one row. A component_id does not tell components apart: all those
    without any id, and those with the same least id, become one row. The pipeline uses
    ``near_copies.one_per_near_copy``, which keeps them apart.
    """
    found = simhash_components(docs, shingle, seed)
    best = found.groupBy("component_id").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    keep = best.select(F.coalesce("best.doc_id", F.lit(0)).alias("id"), "best.none", "best.key")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                       F.col("doc_id").isNull().alias("none"), text_key().alias("key"))
    same = ["id", "none", "key"]
    return rows.join(keep, same, "left_semi").dropDuplicates(same).select("row.*")
