"""Connected components by hooking to smaller neighbours and contracting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fairlead.session import checkpoint

FEW = 10_000  # links, each from both ends, that one task finishes


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of links that connect what all links between the nodes 0 to n - 1 connect, without a circle.

    Each round hooks every root that has a lesser neighbour to its least one.
    """
    top, chosen, open_links = np.arange(n), [np.zeros(0, dtype=np.int64)], np.arange(len(a))
    while len(open_links):
        high, low = top[a[open_links]], top[b[open_links]]
        high, low = np.maximum(high, low), np.minimum(high, low)
        apart = high != low
        open_links, high, low = open_links[apart], high[apart], low[apart]
        in_order = np.lexsort((low, high))
        roots, first = np.unique(high[in_order], return_index=True)
        chosen.append(open_links[in_order[first]])
        top[roots] = low[in_order[first]]
        while ((above := top[top]) != top).any():
            top = above
    return np.concatenate(chosen)


def _finished(links: DataFrame) -> DataFrame:
    """(a, top) of all ends of the last few links, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(node):
            while up.setdefault(node, node) != node:
                up[node] = up[up[node]]
                node = up[node]
            return node

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                up[top(a)] = top(b)
        if up:
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(node) for node in up], kind)], names=["a", "top"])

    kind = links.schema["a"].dataType
    return links.repartition(1).mapInArrow(run, StructType([StructField("a", kind), StructField("top", kind)]))


def connected_components(nodes: DataFrame, edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component): the smallest node of each component.

    Each round hooks every root to its first neighbour in a hashed order, follows two links
    and contracts the edges onto the new roots. The order changes with the round, so hooks
    form shallow trees on chains and stars alike and the graph shrinks geometrically. Rounds
    end in a checkpoint, which survives lost executors, and go on until no edge is left: every
    round hooks at least the root that comes last in the round's order, so they end. Once no more than
    ``few`` links are left, one task does the rest.
    """
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    links = checkpoint(edges.select("a", "b").unionByName(flipped).filter("a <> b").distinct())
    labels = nodes.select("node", F.col("node").alias("root")).distinct()
    turn = 0
    while left := links.count():
        if left <= few:
            labels = checkpoint(labels.join(_finished(links).withColumnRenamed("a", "root"), "root", "left").select(
                "node", F.coalesce("top", "root").alias("root")))
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)), F.col(c))
        hooks = links.groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        hooks = checkpoint(hooks.select("a", F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("up")))
        above = hooks.select(F.col("a").alias("up"), F.col("up").alias("top"))
        roots = checkpoint(hooks.join(above, "up").select("a", "top"))
        labels = checkpoint(labels.join(roots.withColumnRenamed("a", "root"), "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")))
        at = lambda c: roots.select(F.col("a").alias(c), F.col("top").alias(f"top_{c}"))
        links = checkpoint(links.join(at("a"), "a").join(at("b"), "b").select(
            F.col("top_a").alias("a"), F.col("top_b").alias("b")).filter("a <> b").distinct())
        turn += 1
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
