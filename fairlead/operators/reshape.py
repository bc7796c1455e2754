"""Pivots, melts, pairs, selections and row documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions.text import parse_selection
from fairlead.operators.windows import position


def fill_range(df: DataFrame, key: str, start: int, end: int, fill: dict, by: list[str] = ()) -> DataFrame:
    """One row per key in [start, end), for each group of ``by``; absent measures take the fill values."""
    kind = df.schema[key].dataType
    if not by:
        spine = df.sparkSession.range(start, end).select(F.col("id").cast(kind).alias(key))
    else:
        every = F.explode(F.sequence(F.lit(start), F.lit(end - 1)))
        spine = df.select(*by).distinct().withColumn(key, every).withColumn(key, F.col(key).cast(kind))
    return spine.join(df, [*by, key], "left").fillna(fill)


def to_documents(df: DataFrame, cols: list[str], row_index: str, route: str, ferry: str) -> DataFrame:
    """Each row as ``col: value, ...`` text with its index, route and ferry."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in cols]
    meta = F.struct(F.col(row_index).alias("row_index"), F.col(route).alias("route"), F.col(ferry).alias("ferry"))
    return df.select(F.concat_ws(", ", *parts).alias("document"), meta.alias("metadata"))


def pivot_telemetry(df: DataFrame, params: list[str], by: list[str] = ("time",), param: str = "parameter_id",
                    value: str = "value", tiebreak: str | None = None) -> DataFrame:
    """Time x parameter with the first value of each; ``tiebreak`` makes 'first' certain.

    The parameter list is given, so no extra job looks for it and the same
    conditional aggregates run on a stream.
    """
    first = (lambda c: F.min_by(value, F.when(c & F.col(value).isNotNull(), F.col(tiebreak)))) if tiebreak else (
        lambda c: F.first(F.when(c, F.col(value)), ignorenulls=True))
    return df.filter(F.col(param).isin(params)).groupBy(*by).agg(*[first(F.col(param) == p).alias(p) for p in params])


def score_matrix(df: DataFrame, block: str, treatment: str, value: str, treatments: list[str]) -> DataFrame:
    """Block x treatment table of mean values, complete rows only."""
    means = df.groupBy(block, treatment).agg(F.avg(value).alias("_mean"))
    wide = means.groupBy(block).pivot(treatment, treatments).agg(F.first("_mean"))
    return wide.dropna(subset=treatments)


def complete_scores(df: DataFrame, block: str, treatment: str, value: str, by: list[str] = ()) -> DataFrame:
    """Mean value per block and treatment, of blocks that have every treatment (long form).

    Means are rounded to 12 places: equal means tie whatever order they were summed in.
    """
    means = df.groupBy(*by, block, treatment).agg(F.round(F.avg(value), 12).alias(value)).filter(F.col(value).isNotNull())
    seen = df.select(*by, treatment).distinct()
    if by:
        width = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    else:
        width = seen.agg(F.count(F.lit(1)).alias("_k"))
    have = means.groupBy(*by, block).agg(F.count(F.lit(1)).alias("_n"))
    # ``by`` names a handful of metrics, so ``width`` holds that many rows.
    have = have.join(F.broadcast(width), list(by)) if by else have.join(F.broadcast(width))
    return means.join(have.filter(F.col("_n") == F.col("_k")).select(*by, block), [*by, block], "left_semi")


def missing_report(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Blocks without a value per treatment, as a pivot would show them."""
    means = df.groupBy(block, treatment).agg(F.avg(value).alias("_mean"))
    blocks = df.filter(F.col(block).isNotNull()).select(block).distinct().agg(F.count(F.lit(1)).alias("n_blocks"))
    held = means.groupBy(treatment).agg(F.count("_mean").alias("_held"))
    return held.join(F.broadcast(blocks)).select(treatment, (F.col("n_blocks") - F.col("_held")).alias("n_missing"))


def melt(df: DataFrame, ids: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long in one scan."""
    return df.unpivot(ids, metrics, name, value)


def melt_metrics(perf: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """``avg_x``/``stddev_x`` column pairs as (metric, avg, stddev) rows."""
    rows = [
        F.struct(F.lit(x).alias("metric"), F.col(f"avg_{x}").alias("avg"), F.col(f"stddev_{x}").alias("stddev"))
        for x in metrics
    ]
    return perf.select(*ids, F.inline(F.array(*rows)))


def pairs(df: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """Each unordered pair of keys once, smaller first (for few keys, such as models)."""
    keys = df.select(*by, key).distinct()
    left = keys.select(*by, F.col(key).alias(f"{key}_1"))
    right = keys.select(*by, F.col(key).alias(f"{key}_2"))
    lower = F.col(f"{key}_1") < F.col(f"{key}_2")
    if by:
        return left.join(right, list(by)).filter(lower)
    return left.join(right, lower)


def rename(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename columns; by default the stored spelling of one score."""
    return df.withColumnsRenamed(aliases or {"rogue_score": "rouge_score"})


def select_tests(df: DataFrame, spec: str, order: str) -> DataFrame:
    """Rows at the 1-based positions of a selection such as ``"1,3,7-10"``."""
    wanted = F.array_contains(parse_selection(F.lit(spec)), F.col("position").cast("int"))
    return position(df, order).filter(wanted)


def plan_runs(cases: DataFrame, n: int) -> DataFrame:
    """Every case once per run number 1..n, pending."""
    return cases.withColumn("run_number", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "status", F.lit("pending")
    )


# Display names of known models.
MODEL_ALIASES = {
    "anthropic/claude-3.7-sonnet": "Claude 3.7 Sonnet",
    "qwen/qwen-2.5-72b-instruct": "Qwen 2.5 72B",
    "meta-llama/llama-3.3-70b-instruct": "Llama 3.3 70B",
    "meta-llama/llama-3.1-8b-instruct": "Llama 3.1 8B",
    "mistralai/ministral-8b": "Ministral 8B",
}


def alias_models(df: DataFrame, model: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Display name per distinct model; unmapped ones are numbered by their place among all names.

    The input lists models, not results: its distinct names are few.
    """
    mapping = MODEL_ALIASES if mapping is None else mapping
    names = df.select(model).distinct()
    place = F.row_number().over(W.orderBy(model))
    known = F.coalesce(*[F.when(F.col(model) == m, F.lit(a)) for m, a in mapping.items()], F.lit(None))
    return names.withColumn("_i", place).select(
        model, F.coalesce(known, F.concat(F.lit("Model "), F.col("_i").cast("string"))).alias("alias")
    )
