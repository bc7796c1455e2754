"""Exact ranks and quantiles over groups of any size and values of any unit.

Values are counted first, so ties and hot values collapse before the shuffle;
cumulative counts are running sums over sampled ranges of the values of a large key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.operators import scan


def value_counts(df: DataFrame, by: list[str], value: str, *extra: Column) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_equal"), *extra)


def cumulative(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add ``n_below`` (rows with smaller values) and ``n_total`` to value counts.

    The different values of a key are ranked in one task while they fit it, else dealt to ranges whose
    splitters are sampled from the values themselves, so neither unit nor spread matters.
    """
    totals = counts.groupBy(*[F.col(k).alias(f"_of_{k}") for k in by]).agg(F.sum("n_equal").alias("n_total"))
    ranked = scan.by_ranges(counts, by, [value], lambda rows, ranges: scan.running(
        rows, ranges, by, [value], F.col("n_equal"), "n_below"))
    return ranked.withColumn("n_below", F.col("n_below") - F.col("n_equal")).join(
        totals, scan.same_key(by, lambda k: f"_of_{k}")).drop(*[f"_of_{k}" for k in by])


def avg_rank(df: DataFrame, block: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank inside a small block; tied values share their mean rank."""
    ordered = W.partitionBy(*block).orderBy(value)
    ties = W.partitionBy(*block, value)
    return df.withColumn("n_tied", F.count(F.lit(1)).over(ties)).withColumn(
        out, F.rank().over(ordered) + (F.col("n_tied") - 1) / 2
    )


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without holding a group in memory."""
    ranked = cumulative(value_counts(df, by, value), by, value)
    aggs = []
    for name, q in points.items():
        place = (F.col("n_total") - 1) * F.lit(q)
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n_equal"))
            aggs.append(F.max(F.when(held, F.col(value))).alias(f"_{name}_{side}"))
    out = ranked.groupBy(*by).agg(F.max("n_total").alias("n"), *aggs)
    for name, q in points.items():
        place = (F.col("n") - 1) * F.lit(q)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, low + (high - low) * (place - F.floor(place))).drop(f"_{name}_lo", f"_{name}_hi")
    return out


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, exact median and population deviation per key."""
    moments = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return moments.join(quantiles(df, by, value, {"median": 0.5}), by).select(
        *by, "n", "mean", "median", "std"
    )


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the number of outliers."""
    counts = value_counts(df, by, value)
    box = quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn(
        "_reach", 1.5 * (F.col("q3") - F.col("q1"))
    )
    inside = (F.col(value) >= F.col("q1") - F.col("_reach")) & (F.col(value) <= F.col("q3") + F.col("_reach"))
    return counts.join(box, by).groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n_equal"))).alias("n_outliers"),
    )


def boxplot_outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The outlying values themselves, with their counts."""
    box = quantiles(df, by, value, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return value_counts(df, by, value).join(box, by).filter(
        (F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)
    ).select(*by, value, F.col("n_equal").alias("n"))
