"""Prefix scans by key and order that stay parallel when one key holds most rows.

A plain window sends all rows of a key to one task, which is right while a key fits one. The rows of larger keys
are dealt to ranges of (key, order) by sampled splitters, so that a key, or one hour of it, covers as many tasks
as it needs. Each range is scanned by itself; one row per range and key carries what a following range needs
(the last row, a sum, a composed map), and these rows are combined in range order by an associative rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.session import checkpoint

# Rows of one key that a single task may sort; beyond it the key is dealt to ranges.
TASK_ROWS = 500_000
RANGE = "_range"

# What a scan does with rows, given the range column of dealt rows or nothing: both lead its partitioning.
Step = Callable[[DataFrame, list[str]], DataFrame]


def same_key(keys: list[str], other: Callable[[str], str]) -> Column:
    """Equal keys, null equal to null, as windows and groups take them."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(other(k))) for k in keys], F.lit(True))


def large_keys(df: DataFrame, by: list[str]) -> DataFrame | None:
    """Keys with more rows than a task may sort (at most one per TASK_ROWS rows); nothing when there are none."""
    keys = [F.col(k).alias(f"_key_{k}") for k in by]
    counts = df.groupBy(*keys) if by else df
    large = counts.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TASK_ROWS).drop("_n")
    return None if large.isEmpty() else checkpoint(large) if by else large


def by_ranges(df: DataFrame, by: list[str], order: list[str], step: Step, bounded: bool = False,
              sized: DataFrame | None = None) -> DataFrame:
    """Apply a step to whole keys, and to ranges where a key is large.

    ``bounded`` keys, such as a vessel's day, are never looked at for size; ``sized`` has as many rows per key
    or more and is cheaper to count. The ranges are stored before they are scanned, so all that is
    derived from them sees the same ones.
    """
    large = None if bounded else large_keys(df if sized is None else sized, by)
    if large is None:
        return step(df, [])
    same = same_key(by, lambda k: f"_key_{k}")
    rows = df.join(large, same, "left_semi") if by else df
    dealt = checkpoint(rows.repartitionByRange(*by, *order).withColumn(RANGE, F.spark_partition_id()))
    spread = step(dealt, [RANGE]).drop(RANGE)
    return step(df.join(large, same, "left_anti"), []).unionByName(spread) if by else spread


def carried(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """One row per range and key with the given aggregates, for windows over the ranges of a key."""
    return rows.groupBy(RANGE, *by).agg(*[v.alias(n) for n, v in values.items()])


def over_ranges(by: list[str]):
    return W.partitionBy(*by).orderBy(RANGE)


def with_carried(rows: DataFrame, edges: DataFrame, by: list[str], *names: str) -> DataFrame:
    """Add what the ranges before or after brought; edges without any are left out of the join."""
    edges = edges.filter(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])).select(
        *[F.col(k).alias(f"_edge_{k}") for k in [RANGE, *by]], *names)
    return rows.join(edges, same_key([RANGE, *by], lambda k: f"_edge_{k}"), "left").drop(*[f"_edge_{k}" for k in [RANGE, *by]])


def neighbour(rows: DataFrame, ranges: list[str], by: list[str], order: list[str], cols: dict[str, str], ahead: bool = False,
              there: str | None = None) -> DataFrame:
    """Step: values of the row before (or ``ahead``); ``there`` tells whether there is such a row."""
    packed = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *cols])])
    shift = F.lead if ahead else F.lag
    rows = rows.withColumn("_near", shift(packed).over(W.partitionBy(*ranges, *by).orderBy(*order)))
    if ranges:
        edge = (F.min_by if ahead else F.max_by)(packed, F.struct(*order))
        edges = carried(rows, by, _edge=edge).withColumn("_far", shift("_edge").over(over_ranges(by)))
        rows = with_carried(rows, edges, by, "_far").withColumn("_near", F.coalesce("_near", "_far")).drop("_far")
    rows = rows.withColumns({new: F.col("_near")[c] for c, new in cols.items()})
    return (rows.withColumn(there, F.col("_near").isNotNull()) if there else rows).drop("_near")


def running(rows: DataFrame, ranges: list[str], by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Step: inclusive running sum, the sums of all ranges before added."""
    so_far = W.partitionBy(*ranges, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_value", value)
    rows = rows.withColumn(out, F.coalesce(F.sum("_value").over(so_far), F.lit(0)))
    if ranges:
        before = over_ranges(by).rowsBetween(W.unboundedPreceding, -1)
        edges = carried(rows, by, _sum=F.sum("_value")).withColumn("_offset", F.sum("_sum").over(before))
        rows = with_carried(rows, edges, by, "_offset").withColumn(out, F.col(out) + F.coalesce("_offset", F.lit(0))).drop("_offset")
    return rows.drop("_value")


def nearest_known(rows: DataFrame, ranges: list[str], by: list[str], order: str, value: str, back: str, ahead: str) -> DataFrame:
    """Step: the last known value at or before each row and the first at or after it, by a numeric order."""
    # The way ahead is the way back in reverse order: frames that only grow cost one step per row.
    so_far = lambda o: W.partitionBy(*ranges, *by).orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({back: F.last(value, ignorenulls=True).over(so_far(F.col(order).asc())),
                             ahead: F.last(value, ignorenulls=True).over(so_far(F.col(order).desc()))})
    if ranges:
        known = F.when(F.col(value).isNotNull(), F.col(order))
        edges = carried(rows, by, _last=F.max_by(value, known), _first=F.min_by(value, known)).withColumns({
            "_before": F.last("_last", ignorenulls=True).over(over_ranges(by).rowsBetween(W.unboundedPreceding, -1)),
            "_after": F.last("_first", ignorenulls=True).over(W.partitionBy(*by).orderBy(F.col(RANGE).desc()).rowsBetween(
                W.unboundedPreceding, -1))})
        rows = with_carried(rows, edges, by, "_before", "_after").withColumns({
            back: F.coalesce(back, "_before"), ahead: F.coalesce(ahead, "_after")}).drop("_before", "_after")
    return rows


def fold(df: DataFrame, by: list[str], order: list[str], factor: Column, term: Column, **also: Column) -> DataFrame:
    """Compose the maps x -> factor * x + term of each key's rows in order: (key, factor, term, others).

    Composition is associative though not commutative: a range's maps become one, and the ranges' maps are
    composed by the same rule. ``also`` are aggregates computed beside, over the whole key.
    """
    def compose(maps: DataFrame, keys: list[str], inner: list[str]) -> DataFrame:
        # Each map is scaled by the factors of those after it, taken from the end so that the frame only grows.
        later = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in inner]).rowsBetween(W.unboundedPreceding, -1)
        scaled = maps.withColumn("_scale", F.coalesce(F.product("factor").over(later), F.lit(1.0)))
        return scaled.groupBy(*keys).agg(F.product("factor").alias("factor"), F.sum(F.col("term") * F.col("_scale")).alias("term"))

    maps = df.withColumns({"factor": factor, "term": term})

    def step(rows: DataFrame, ranges: list[str]) -> DataFrame:
        composed = compose(rows, [*ranges, *by], order)
        return compose(composed, by, ranges) if ranges else composed

    folded = by_ranges(maps.select(*by, *order, "factor", "term"), by, order, step)
    if not also:
        return folded
    rest = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in by]).agg(*[c.alias(n) for n, c in also.items()])
    return folded.join(rest, same_key(by, lambda k: f"_of_{k}")).drop(*[f"_of_{k}" for k in by])
