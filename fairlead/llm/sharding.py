"""Sharding by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import number_within, text_key, written

# Groups differenced by one task, and partial partitions combined by one task of the next level.
BUCKET_GROUPS = 20_000
FAN_IN = 500


def differencing(parts: np.ndarray) -> np.ndarray:
    """Labels that combine partial partitions into one, by Karmarkar and Karp's differencing.

    ``parts`` has a row of k sums per partial partition (a single group: its size and zeros).
    The two rows of largest spread are combined, the largest sums of one with the smallest of the
    other, until one row is left. Returns for each row and place the place in the final one.
    """
    n, k = parts.shape
    if not n:
        return np.zeros((0, k), np.int64)
    first = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, first, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(sums)))
        made.append((a, b, order))
        sums.append(both)
        sums[a] = sums[b] = None
    label: list = [None] * len(sums)
    label[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = made[node - n]
        label[a], label[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        label[a][order] = label[node]
        label[b][k - 1 - order] = label[node]
        label[node] = None
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, first, np.stack(label[:n]), axis=1)
    return out


def shard_groups(groups: DataFrame, shards: int, n_groups: int, bucket_groups: int = BUCKET_GROUPS,
                 fan_in: int = FAN_IN) -> DataFrame:
    """(group, shard) for groups (group, bytes), each kept whole, with near equal sums of bytes.

    Buckets of groups are differenced in parallel into partial partitions of ``shards`` sums; those
    are differenced again, up to ``fan_in`` at a time, until one is left. A group is never cut, so
    one larger than a fair share fills a shard by itself.
    """
    buckets = max(1, -(-n_groups // bucket_groups))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], kind="stable")
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        return pd.DataFrame({"group": pdf["group"], "bytes": pdf["bytes"], "node": pdf["node"],
                             "place": differencing(parts)[:, 0]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(pdf["node"].unique())
        parts = np.zeros((len(nodes), shards), np.int64)
        parts[np.searchsorted(nodes, pdf["node"]), pdf["place"]] = pdf["bytes"]
        to = differencing(parts)
        return pd.DataFrame({"node": np.repeat(nodes, shards), "place": np.tile(np.arange(shards), len(nodes)),
                             "to": to.reshape(-1)})

    dealt = groups.withColumn("node", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    placed = written(dealt.groupBy("node").applyInPandas(
        leaves, "group binary, bytes long, node long, place long"), "differenced")
    while buckets > 1:
        parents = -(-buckets // fan_in)
        sums = placed.groupBy("node", "place").agg(F.sum("bytes").alias("bytes"))
        moves = sums.withColumn("parent", F.pmod("node", F.lit(parents))).groupBy("parent").applyInPandas(
            merge, "node long, place long, to long")
        placed = written(placed.join(moves, ["node", "place"]).select(
            "group", "bytes", F.pmod("node", F.lit(parents)).alias("node"), F.col("to").alias("place")), "differenced")
        buckets = parents
    return placed.select("group", F.col("place").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Put every document into one of ``shards`` with near equal bytes; equal texts stay together.

    One row per input row: doc_id, size (UTF-8 bytes of the text plus ``overhead``; a null text has
    no bytes and groups with the empty ones), text_crc32, shard, slot (gapless from 0 in its shard).
    Null ids, ties and repeated rows keep their own rows and slots; an empty table gives no row;
    other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key().alias("group")), "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total, distinct = rows.count(), rows.select("group").distinct().count()
    assigned = rows.join(shard_groups(groups, shards, distinct), "group")
    return number_within(assigned, ["shard"], ["doc_id", "size", "text_crc32", "group"], "slot", total).select(
        "doc_id", "size", "text_crc32", "shard", "slot")
