"""Significance tests over (block, treatment, value) scores.

Means, ranks, rank sums and tie counts are Spark aggregates; only the tail
probabilities of the few resulting rows are computed in Python.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fairlead.functions import tails
from fairlead.operators.ranks import avg_rank, cumulative
from fairlead.operators.reshape import complete_scores, pairs

ALL = "all"  # name of the only group when scores are not split by metric


@F.pandas_udf(DoubleType())
def _chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        tails.chi_square_tail(x, int(d)) if pd.notna(x) else None for x, d in zip(statistic, df)
    ], dtype="float64")


@F.pandas_udf(DoubleType())
def _range_p(q: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([tails.studentized_range_tail(x, int(n)) for x, n in zip(q, k)], dtype="float64")


@F.pandas_udf(DoubleType())
def _signed_rank_p(w: pd.Series, n: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([
        tails.signed_rank_p(a, int(b), c, bool(e)) for a, b, c, e in zip(w, n, ties, exact)
    ], dtype="float64")


def _ranked(scores: DataFrame, block: str, treatment: str, value: str, by: str) -> DataFrame:
    # A block holds one row per treatment, so its ranking window is small.
    return avg_rank(complete_scores(scores, block, treatment, value, [by]), [by, block], value)


def _by(scores: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    return (scores, by) if by else (scores.withColumn("metric", F.lit(ALL)), "metric")


def rank_sums(scores: DataFrame, block: str, treatment: str, value: str, by: str | None = None) -> DataFrame:
    """Rank sum, mean rank and number of blocks per treatment over complete blocks."""
    scores, by = _by(scores, by)
    ranked = _ranked(scores, block, treatment, value, by)
    return ranked.groupBy(by, treatment).agg(
        F.sum("rank").alias("rank_sum"), F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"),
        # Each of t tied rows adds t^2 - 1, together the t^3 - t of the tie correction.
        F.sum(F.col("n_tied") * F.col("n_tied") - 1).alias("tie_sum"),
    )


def friedman(scores: DataFrame, block: str, treatment: str, value: str, by: str | None = None) -> DataFrame:
    """Friedman chi-square with tie correction per metric; an error text when it cannot run."""
    grouped, key = _by(scores, by)
    sums = rank_sums(grouped, block, treatment, value, key)
    n, k = F.col("n"), F.col("k")
    # Metrics without a complete block still get a row.
    width = grouped.groupBy(key).agg(F.countDistinct(treatment).alias("k"))
    tests = sums.groupBy(key).agg(
        F.max("n").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("_sq"), F.sum("tie_sum").alias("_ties"),
    )
    tests = width.join(tests, key, "left").withColumn("n", F.coalesce(n, F.lit(0)))
    error = (
        F.when((n < 2) | (k < 2), F.lit("Not enough data for Friedman test"))
        .when(k < 3, F.lit("At least 3 sets of samples must be given"))
    )
    raw = 12 / (n * k * (k + 1)) * F.col("_sq") - 3 * n * (k + 1)
    correction = 1 - F.col("_ties") / (n * k * (k * k - 1))
    statistic = F.when(F.col("error").isNull(), F.try_divide(raw, correction))
    return (
        tests.withColumn("error", error).withColumn("statistic", statistic)
        .withColumn("p_value", _chi_square_p("statistic", (k - 1).cast("int")))
        .select(key, "statistic", "p_value", "n", "k", "error")
    )


def nemenyi(ranks: DataFrame, treatment: str, by: str = "metric") -> DataFrame:
    """Pairwise comparison of mean ranks, given ``rank_sums`` rows."""
    width = ranks.groupBy(by).agg(F.count(F.lit(1)).alias("k"))  # a row per metric
    side = lambda i: ranks.select(by, F.col(treatment).alias(f"{treatment}_{i}"), F.col("mean_rank").alias(f"_r{i}"),
                                  *([F.col("n")] if i == 1 else []))
    both = side(1).join(side(2), by).filter(F.col(f"{treatment}_1") < F.col(f"{treatment}_2")).join(F.broadcast(width), by)
    q = F.abs(F.col("_r1") - F.col("_r2")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n")))
    return both.withColumn("q", q).withColumn("p_value", _range_p(F.col("q") * math.sqrt(2), "k")).select(
        by, f"{treatment}_1", f"{treatment}_2", "q", "p_value"
    )


def wilcoxon_pairs(scores: DataFrame, block: str, treatment: str, value: str, by: str | None = None,
                   alpha: float = 0.05, exact_up_to: int = 50) -> DataFrame:
    """Signed-rank test of every treatment pair over complete blocks, Bonferroni-adjusted.

    Equal pairs drop out. Differences are rounded to 12 places, so that values equal
    but for summation order tie. Up to ``exact_up_to`` differences without ties or zeros the p-value is exact.
    """
    scores, by = _by(scores, by)
    full = complete_scores(scores, block, treatment, value, [by])
    a, b = f"{treatment}_1", f"{treatment}_2"
    # The cross of treatments within a block is bounded by their number.
    left = full.select(by, block, F.col(treatment).alias(a), F.col(value).alias("_x"))
    right = full.select(by, block, F.col(treatment).alias(b), F.col(value).alias("_y"))
    diffs = left.join(right, [by, block]).filter(F.col(a) < F.col(b)).select(
        by, a, b, F.round(F.col("_x") - F.col("_y"), 12).alias("d")
    )
    keys = [by, a, b]
    zeros = diffs.groupBy(*keys).agg(F.count_if(F.col("d") == 0).alias("n_zero"))
    counts = diffs.filter(F.col("d") != 0).groupBy(*keys, F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("n_equal"), F.count_if(F.col("d") > 0).alias("n_up")
    )
    ranked = cumulative(counts, keys, "size").withColumn(
        "rank", F.col("n_below") + (F.col("n_equal") + 1) / 2
    )
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("n_up") * F.col("rank")).alias("up"),
        F.sum((F.col("n_equal") - F.col("n_up")) * F.col("rank")).alias("down"),
        F.sum("n_equal").alias("n"),
        F.sum(F.pow("n_equal", F.lit(3)) - F.col("n_equal")).alias("ties"),
    )
    n_pairs = zeros.groupBy(by).agg(F.count(F.lit(1)).alias("_pairs"))  # a row per metric
    out = zeros.join(sums, keys, "left").join(F.broadcast(n_pairs), by).fillna(0, ["up", "down", "n", "ties"])
    exact = (F.col("n") <= exact_up_to) & (F.col("ties") == 0) & (F.col("n_zero") == 0)
    p = _signed_rank_p(F.col("w"), F.col("n"), F.col("ties"), exact)
    out = out.withColumn("w", F.least("up", "down").cast("double")).withColumn("p_value", p)
    adjusted = F.least(F.col("p_value") * F.col("_pairs"), F.lit(1.0))
    return out.withColumn("p_adjusted", adjusted).select(
        *keys, "w", "n", "p_value", "p_adjusted", (F.col("p_adjusted") < alpha).alias("significant")
    )


def compare_all(rows: DataFrame, block: str, treatment: str, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """One Friedman line per metric, all metrics in one job."""
    scores = rows.unpivot([block, treatment], list(metrics), "metric", "score")
    tests = friedman(scores, block, treatment, "score", "metric")
    return tests.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def significant_pairs(rows: DataFrame, block: str, treatment: str, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """Nemenyi pairs of the metrics whose Friedman test is significant."""
    scores = rows.unpivot([block, treatment], list(metrics), "metric", "score")
    hits = friedman(scores, block, treatment, "score", "metric").filter(F.col("p_value") < alpha).select("metric")
    ranks = rank_sums(scores, block, treatment, "score", "metric")
    return nemenyi(ranks.join(F.broadcast(hits), "metric", "left_semi"), treatment)


__all__ = ["friedman", "nemenyi", "wilcoxon_pairs", "compare_all", "significant_pairs", "rank_sums", "pairs"]
