"""Vector code compression: every vector becomes one code per part, codebooks fitted by member-resident Lloyd rounds.

The parts live where their entry is owned: at the task of (position, entry, salt). An owner sums its resident
members; the sums of all owners give the next codebooks. Then each owner looks for the nearest entry of its
members, and only those that change entry travel to their new owner. Both halves of a round are
co-partitioned, so members that stay are never shuffled again. This needs partitions that keep their place,
which RDDs of array blocks offer; a block holds the parts that one task sends to one owner task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import written

# Parts that one owner task holds, about: 50 bytes each in memory.
TASK_PARTS = 250_000
# Vectors per salt: an entry that most vectors share has one salt for each so many of them.
SALT_VECTORS = 500
# Vectors whose parts are dealt together, and parts compared with a codebook together.
DEAL_VECTORS, COMPARE_PARTS = 20_000, 8_000
# Components are cut to this size, so that sums of squares fit 64 bits up to 512 components.
LARGEST = 1 << 26


class Plan(NamedTuple):
    """How vectors are cut and where parts live."""

    parts: int
    width: int
    scale: int
    salts: int
    tasks: int
    record: np.dtype

    def owner(self, position: np.ndarray, entry: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Number of the task that owns (position, entry, salt); the salts of an entry follow each other."""
        place = (position.astype(np.int64) * 256 + entry) * self.salts + key % self.salts
        return place % self.tasks


def finite(vector: str) -> F.Column:
    """A vector that is there and has neither null nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & fine


def integers(vectors: pa.ListArray, plan: Plan) -> np.ndarray:
    """[vectors, parts * width] of floor(scale * x); shorter vectors go on with zeros."""
    lengths = np.asarray(pc.list_value_length(vectors))
    components = np.asarray(vectors.flatten()).astype(np.float64)
    out = np.zeros((len(vectors), plan.parts * plan.width), np.int64)
    inside = np.arange(out.shape[1])[None, :] < lengths[:, None]
    out[inside] = np.clip(np.floor(components * plan.scale), -LARGEST, LARGEST).astype(np.int64)
    return out


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry, the lower one on ties, and its squared distance."""
    entry, error = np.zeros(len(part), np.uint8), np.zeros(len(part), np.int64)
    for i in range(0, len(part), COMPARE_PARTS):
        apart = part[i:i + COMPARE_PARTS, None, :].astype(np.int64) - book[None]
        far = np.einsum("nkw,nkw->nk", apart, apart)
        entry[i:i + COMPARE_PARTS] = far.argmin(1)
        error[i:i + COMPARE_PARTS] = far.min(1)
    return entry, error


def assigned(members: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each member in the codebook of its position."""
    entry, error = np.zeros(len(members), np.uint8), np.zeros(len(members), np.int64)
    for p in np.unique(members["position"]):
        at = members["position"] == p
        entry[at], error[at] = nearest(members["part"][at], books[p])
    return entry, error


def by_owner(members: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """(owner task, its members)."""
    owner = plan.owner(members["position"], members["entry"], members["key"])
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for i, j in zip(first, [*first[1:], len(order)]):
        yield int(owner[order[i]]), members[order[i:j]]


def deal(vectors: DataFrame, books: np.ndarray, plan: Plan) -> RDD:
    """(owner task, members) for all parts of all vectors, by their nearest entry in the first codebooks."""
    def cut(batch: pa.RecordBatch) -> np.ndarray:
        n = batch.num_rows
        ids, labels = batch.column(0), batch.column(1)
        out = np.zeros((n, plan.parts), plan.record)
        out["id"] = np.asarray(ids.fill_null(0))[:, None]
        out["label"] = np.asarray(labels.fill_null(0))[:, None]
        out["nulls"] = (np.asarray(ids.is_null()) + 2 * np.asarray(labels.is_null()))[:, None]
        out["key"] = np.asarray(batch.column(2))[:, None]
        out["position"] = np.arange(plan.parts)[None, :]
        out["part"] = integers(batch.column(3), plan).reshape(n, plan.parts, plan.width)
        return out.reshape(-1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held):
            members = np.concatenate(held)
            members["entry"] = assigned(members, books)[0]
            to, blocks = zip(*by_owner(members, plan))
            return pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["owner", "block"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(cut(batch))
                n += batch.num_rows
            if n >= DEAL_VECTORS:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    rows = vectors.mapInArrow(run, "owner long, block binary").rdd
    return rows.map(lambda r: (r[0], np.frombuffer(r[1], plan.record))).partitionBy(plan.tasks, int)


def resident(blocks: Iterable[tuple[int, np.ndarray]], plan: Plan) -> np.ndarray:
    """All members of one owner task; its size is bounded by the number of tasks and the salts."""
    held = [b for _, b in blocks]
    return np.concatenate(held) if held else np.zeros(0, plan.record)


def totals(members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position and entry, count and componentwise sums) of the resident members."""
    place = members["position"].astype(np.int64) * 256 + members["entry"]
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    for i, j in zip(first, [*first[1:], len(order)]):
        own = members["part"][order[i:j]].astype(np.int64)
        yield int(place[order[i]]), np.concatenate([[j - i], own.sum(0)])


def lloyd(members: RDD, books: np.ndarray, plan: Plan, rounds: int) -> tuple[RDD, np.ndarray]:
    """Members at their owners after the last round, and the codebooks.

    Each round's members are persisted and the round before is let go; a lost block is built again
    from the moves, which stay deterministic because the codebooks of all rounds are constants of the tasks.
    """
    members = members.persist(StorageLevel.MEMORY_AND_DISK)
    for turn in range(rounds):
        sums = members.mapPartitions(lambda blocks: totals(resident(blocks, plan))).reduceByKey(np.add, 8).collect()
        books = books.copy()
        for place, total in sums:
            books[place // 256, place % 256] = total[1:] // total[0]  # floor, also below zero
        if turn + 1 == rounds:
            break

        def split(blocks, books=books):
            own = resident(blocks, plan)
            entry = assigned(own, books)[0]
            moves = entry != own["entry"]
            own = own.copy()
            own["entry"] = entry
            return own, moves

        def stay(number, blocks, split=split):
            own, moves = split(blocks)
            if not moves.all():
                yield number, own[~moves]

        def move(blocks, split=split):
            own, moves = split(blocks)
            yield from by_owner(own[moves], plan)

        staying = members.mapPartitionsWithIndex(stay, preservesPartitioning=True)
        arriving = members.mapPartitions(move).partitionBy(members.getNumPartitions(), members.partitioner.partitionFunc)
        following = staying.union(arriving).persist(StorageLevel.MEMORY_AND_DISK)
        following.count()
        members.unpersist()
        members = following
    return members, books


def first_books(kept: DataFrame, entries: int, plan: Plan) -> np.ndarray:
    """[parts, entries, width]: the parts of the vectors of smallest ids; at most ``entries`` rows reach the driver."""
    order = [F.col("id").asc_nulls_last()]
    ids = [r[0] for r in kept.select("id").distinct().orderBy(*order).limit(entries).collect()]
    wanted = F.col("id").isin([i for i in ids if i is not None])
    if None in ids:
        wanted = F.coalesce(wanted, F.lit(False)) | F.col("id").isNull()
    rows = kept.filter(wanted).groupBy("id").agg(F.min("vector").alias("vector")).orderBy(*order).collect()
    made = integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), plan)
    return made.reshape(len(rows), plan.parts, plan.width).transpose(1, 0, 2).copy()


def encode_vectors(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
                   vector: str = "embedding", id: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks [parts, entries, width].

    One row per kept input row: id, label, codes (entry per part position), error (squared distance to
    the entries, summed over the parts). Rows are dropped only where the vector is null or has a null or
    non-finite component. Defined for odd rows: vectors shorter than the longest, or whose length is no
    multiple of ``parts``, go on with zeros; components beyond 2^26 after scaling are cut there; a null id comes
    after all others when the first entries are chosen, and of several vectors of one id the least is
    chosen; repeated rows each keep a row; with fewer ids than ``entries`` the codebooks are as
    short; a table without kept rows gives none. Other columns are left out, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    spark = rows.sparkSession
    kept = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).alias("vector")).filter(finite("vector"))
    reach = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))
    n, longest, largest = kept.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(reach)).first()
    width = -(-(longest or 0) // parts)
    # Components are stored in as few bytes as the largest needs.
    kind = "<i2" if (largest or 0.0) * scale < 32_000 else "<i4"
    plan = Plan(parts, width, scale, -(-n // SALT_VECTORS) or 1,
                max(spark.sparkContext.defaultParallelism, -(-n * parts // TASK_PARTS)),
                np.dtype([("id", "<i8"), ("label", "<i8"), ("key", "<i8"), ("nulls", "u1"), ("position", "u1"),
                          ("entry", "u1"), ("part", kind, (width,))]))
    schema = "id long, label long, codes array<int>, error long"
    books = first_books(kept, entries, plan)
    if not n:
        return spark.createDataFrame([], schema), books
    # Equal rows share this key, and nothing else does: id and label are compared beside it.
    vectors = kept.select("id", "label", F.xxhash64("id", "label", "vector").alias("key"), "vector")
    members, books = lloyd(deal(vectors, books, plan), books, plan, rounds)
    told = np.dtype([("id", "<i8"), ("label", "<i8"), ("key", "<i8"), ("nulls", "u1"), ("position", "u1"),
                     ("entry", "u1"), ("error", "<i8")])

    def tell(blocks):
        own = resident(blocks, plan)
        out = np.zeros(len(own), told)
        for name in ("id", "label", "key", "nulls", "position"):
            out[name] = own[name]
        out["entry"], out["error"] = assigned(own, books)
        for i in range(0, len(out), 10_000):
            yield (bytearray(out[i:i + 10_000].tobytes()),)

    def expand(batches):
        for batch in batches:
            for block in batch.column(0):
                r = np.frombuffer(block.as_py(), told)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["id"], mask=(r["nulls"] & 1) > 0), pa.array(r["label"], mask=(r["nulls"] & 2) > 0),
                     pa.array(r["key"]), pa.array(r["position"].astype(np.int32)), pa.array(r["entry"].astype(np.int32)),
                     pa.array(r["error"])], names=["id", "label", "key", "position", "entry", "error"])

    blocks = spark.createDataFrame(members.mapPartitions(tell), "block binary", verifySchema=False)
    told_parts = blocks.mapInArrow(expand, "id long, label long, key long, position int, entry int, error long")
    codes = F.array(*[F.max(F.when(F.col("position") == p, F.col("entry"))) for p in range(parts)])
    whole = told_parts.groupBy("id", "label", "key").agg(
        codes.alias("codes"), F.sum("error").alias("error"), F.expr(f"count(1) div {parts}").alias("copies"))
    # A row met c times is one group: c rows again, through two short lists.
    again = whole.withColumn("error", F.expr("error div copies")).withColumn(
        "hundreds", F.explode(F.expr("sequence(0L, (copies - 1) div 1000)"))).withColumn(
        "copy", F.explode(F.expr("sequence(1L, least(1000L, copies - hundreds * 1000))")))
    out = written(again.select("id", "label", "codes", "error"), "vector_codes")
    members.unpersist()
    return out, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
