"""Scoring a corpus of answers in one pass: look up truths, add score columns, fan out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import metrics as mt
from fairlead.functions.text import clean_number, first_number, is_error, strip
from fairlead.session import join_lookup


@dataclass(frozen=True)
class Metric:
    """A named score in [0, 1] of the listed columns."""

    name: str
    columns: tuple[str, ...]
    score: Callable[..., Column]


REGISTRY: dict[str, Metric] = {}


def register(name: str, columns: tuple[str, ...], score: Callable[..., Column]) -> Metric:
    """Add a metric: ``score`` maps columns to a column, a pandas UDF included."""
    REGISTRY[name] = Metric(name, tuple(columns), score)
    return REGISTRY[name]


register("factual_correctness", ("response", "true_value"),
         lambda response, truth: mt.factual_correctness(first_number(response), truth))
register("bleu_score", ("response", "reference"), mt.bleu_score)
register("non_llm_string_similarity", ("response", "reference"), mt.string_similarity)
register("rogue_score", ("response", "reference"), mt.rouge_score)
register("string_present", ("response", "reference"), mt.string_presence)
register("semantic_similarity", ("response_embedding", "reference_embedding"), mt.cosine)


def with_true_value(answers: DataFrame, cases: DataFrame, reference: str = "reference",
                    case_reference: str = "ground_truth", value: str = "extracted_true_value", order: str = "test_no") -> DataFrame:
    """Add the number registered for an answer's reference text, compared without outer blanks.

    Of several cases with one text the last by ``order`` counts, or the greatest number where cases have no such
    column. Texts are joined by a 128-bit hash, so long ones do not travel.
    """
    key = lambda c: F.md5(strip(F.col(c)).cast("binary"))
    number = strip(F.col(value).cast("string")).try_cast("double")
    place = F.col(order) if order in cases.columns else F.lit(0)
    truths = cases.select(key(case_reference).alias("_key"), F.struct(place.alias("place"), number.alias("v")).alias("case"))
    truths = truths.groupBy("_key").agg(F.max("case").alias("case")).select("_key", F.col("case.v").alias("true_value"))
    return join_lookup(answers.withColumn("_key", key(reference)), truths, "_key", "left").drop("_key")


def add_scores(answers: DataFrame, names: list[str]) -> DataFrame:
    """Add the named metrics; a metric whose columns are absent is an error."""
    chosen = [REGISTRY[n] for n in names]
    for metric in chosen:
        missing = [c for c in metric.columns if c not in answers.columns]
        if missing:
            raise ValueError(f"{metric.name} needs columns {missing}")
    return answers.withColumns({m.name: m.score(*[F.col(c) for c in m.columns]) for m in chosen})


TEXT_METRICS = ("factual_correctness", "bleu_score", "non_llm_string_similarity", "rogue_score", "string_present")


def score(answers: DataFrame, cases: DataFrame, metrics: list[str] = TEXT_METRICS) -> DataFrame:
    """All answers against their cases: (response, reference) rows plus one column per metric."""
    return add_scores(with_true_value(answers, cases), list(metrics))


def verdict_ratio(verdicts: DataFrame, key: str, supported: str = "supported", out: str = "faithfulness") -> DataFrame:
    """Supported claims over claims per answer."""
    return verdicts.groupBy(key).agg(F.avg(F.col(supported).cast("int")).alias(out), F.count(supported).alias("n_claims"))


def run_record(scored: DataFrame, response: str = "response", scores: list[str] = TEXT_METRICS) -> DataFrame:
    """Outcome flags of each run; a failed call keeps no scores."""
    failed = F.col(response).isNull() | is_error(F.coalesce(F.col(response), F.lit("")))
    kept = {s: F.when(~failed, F.col(s)) for s in scores}
    # Columns of one call read the input, so the flags see the scores as they were.
    present = F.coalesce(*[F.col(s) for s in scores]).isNotNull()
    return scored.withColumns({
        **kept, "call_ok": ~failed, "scored_ok": ~failed & present,
    })


def clean_replies(df: DataFrame, reply: str, out: str = "number") -> DataFrame:
    return df.withColumn(out, clean_number(F.col(reply)))


def coerce_scores(df: DataFrame, scores: list[str]) -> DataFrame:
    """Scores as floating point, or null where they are no numbers."""
    def number(col: Column, kind: str) -> Column:
        value = col.cast("double") if kind != "string" else col.try_cast("double")
        return F.when(~F.isnan(value), value)
    kinds = dict(df.dtypes)
    return df.withColumns({s: number(F.col(s), kinds[s]) for s in scores})
