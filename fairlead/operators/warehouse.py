"""Joins, summaries and reports over the evaluation store.

``store`` maps the names of the five tables to DataFrames. Results, evaluations,
metrics and tokens meet on result ids; texts stay out of every aggregate, and the
model dimension joins after rows have been aggregated per model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.text import clip, is_error, percent_done
from fairlead.operators import scan
from fairlead.session import join_lookup

SCORES = ("factual_correctness", "semantic_similarity", "context_recall", "faithfulness", "bleu_score",
          "non_llm_string_similarity", "rogue_score", "string_present")
REPORT_SCORES = SCORES[:4]
TOKENS = ("total_tokens", "prompt_tokens", "completion_tokens")
Store = dict[str, DataFrame]


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _models(store: Store) -> DataFrame:
    return _renamed(store["llm_models"], llm_model_id="id", model_name="name", model_type="type")


def _evaluations(store: Store) -> DataFrame:
    return _renamed(store["query_evaluation"], evaluation_id="id", query_result_id="query_result_id",
                    evaluation_metrics_id="evaluation_metrics_id")


def _metrics(store: Store) -> DataFrame:
    return store["evaluation_metrics"].withColumnRenamed("id", "evaluation_metrics_id")


def _tokens(store: Store) -> DataFrame:
    return store["token_usage"].withColumnRenamed("id", "token_usage_id")


def full_query_data(store: Store) -> DataFrame:
    """Every evaluated answer with its scores, model and tokens."""
    results = store["query_result"].withColumnsRenamed({"id": "query_result_id", "timestamp": "query_timestamp"})
    rows = results.join(_evaluations(store), "query_result_id").join(_metrics(store), "evaluation_metrics_id")
    rows = join_lookup(rows, _models(store), "llm_model_id").join(_tokens(store), "query_result_id", "left")
    return rows.select(
        "query_result_id", "query", "direct_response", "full_response", "sql_queries", "tool_calls", "query_timestamp",
        F.col("evaluation_metrics_id").alias("evaluation_metric_id"), *SCORES, "model_name", "token_usage_id",
        "prompt_tokens", "completion_tokens", "total_tokens",
    )


def scores(store: Store) -> DataFrame:
    """Query text, model and scores of every evaluated answer, for significance tests."""
    keys = store["query_result"].select(F.col("id").alias("query_result_id"), "llm_model_id", "query")
    rows = keys.join(_evaluations(store), "query_result_id").join(_metrics(store), "evaluation_metrics_id")
    return join_lookup(rows, _models(store), "llm_model_id").select("query", "model_name", *SCORES)


def _scored(store: Store, how: str) -> DataFrame:
    """Results with evaluations (``how``), metrics and tokens, without texts or model names."""
    keys = store["query_result"].select(F.col("id").alias("query_result_id"), "llm_model_id", "timestamp")
    return (
        keys.join(_evaluations(store), "query_result_id", how)
        .join(_metrics(store), "evaluation_metrics_id", "left")
        .join(_tokens(store), "query_result_id", "left")
    )


def performance(store: Store, type: str | None = None) -> DataFrame:
    """Mean and deviation of each score per model; several token rows multiply a result's weight."""
    per_model = _scored(store, "inner").groupBy("llm_model_id").agg(
        *[F.avg(s).alias(f"avg_{s}") for s in SCORES],
        *[F.stddev_samp(s).alias(f"stddev_{s}") for s in SCORES],
        F.count("evaluation_id").alias("query_evaluation_count"),
        *[F.avg(c).alias(f"avg_{c}") for c in TOKENS],
    )
    models = _models(store)
    if type is not None:
        models = models.filter(F.col("model_type") == type)
    return models.join(per_model, "llm_model_id").withColumnRenamed("llm_model_id", "model_id")


def summary(store: Store) -> DataFrame:
    """Result count, mean scores and mean tokens per model, most results first."""
    per_model = _scored(store, "left").groupBy("llm_model_id").agg(
        F.count("query_result_id").alias("query_evaluation_count"),
        *[F.avg(s).alias(f"avg_{s}") for s in REPORT_SCORES], F.avg("total_tokens").alias("avg_total_tokens"),
    )
    return _models(store).join(per_model, "llm_model_id").drop("llm_model_id").orderBy(
        F.desc("query_evaluation_count"), "model_name"
    )


def statistics(store: Store) -> DataFrame:
    """Distinct results and models, time range and mean scores of the whole store."""
    keys = store["query_result"].select(F.col("id").alias("query_result_id"), "llm_model_id", "timestamp")
    keys = join_lookup(keys, _models(store).select("llm_model_id", "model_name"), "llm_model_id")
    rows = keys.join(_evaluations(store), "query_result_id", "left").join(_metrics(store), "evaluation_metrics_id", "left")
    # One row per result first: it keeps the join's partitioning and replaces a two-way distinct.
    sums = [x for s in REPORT_SCORES for x in (F.sum(s).alias(f"s_{s}"), F.count(s).alias(f"n_{s}"))]
    per_result = rows.groupBy("query_result_id", "model_name").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), *sums
    )
    return per_result.agg(
        F.count(F.lit(1)).alias("total_queries"), F.countDistinct("model_name").alias("models_tested"),
        F.min("first").alias("earliest_test"), F.max("last").alias("latest_test"),
        *[F.try_divide(F.sum(f"s_{s}"), F.sum(f"n_{s}")).alias(f"avg_{s}") for s in REPORT_SCORES],
    )


def report_rows(store: Store, results: DataFrame | None = None) -> DataFrame:
    """Results with models and, where present, evaluations and tokens; unevaluated ones stay."""
    results = (store["query_result"] if results is None else results).withColumnRenamed("id", "query_id")
    evaluations = _evaluations(store).withColumnRenamed("query_result_id", "query_id")
    tokens = _tokens(store).withColumnRenamed("query_result_id", "query_id")
    return (
        join_lookup(results, _models(store), "llm_model_id")
        .join(evaluations, "query_id", "left").join(_metrics(store), "evaluation_metrics_id", "left")
        .join(tokens, "query_id", "left")
    )


def _latest(store: Store, n: int, model: str | None = None) -> DataFrame:
    """The latest ``n`` report rows.

    Each result yields at least one row, so the latest n results suffice: they are
    picked before the joins, which then meet only the evaluations of those results.
    """
    models = _models(store)
    if model is not None:
        models = models.filter(F.col("model_name") == model)
    newest = [F.desc("timestamp"), F.desc("id")]
    heads = join_lookup(store["query_result"], models.select("llm_model_id"), "llm_model_id", "left_semi")
    heads = heads.orderBy(*newest).limit(n)
    ids = F.broadcast(heads.select(F.col("id").alias("query_result_id")))  # n rows at most
    near = dict(store)
    for name in ("query_evaluation", "token_usage"):
        near[name] = store[name].join(ids, "query_result_id", "left_semi")
    wanted = near["query_evaluation"].select(F.col("evaluation_metrics_id").alias("id"))
    near["evaluation_metrics"] = store["evaluation_metrics"].join(wanted, "id", "left_semi")
    near["llm_models"] = store["llm_models"]
    rows = report_rows(near, heads)
    return rows.orderBy(F.desc("timestamp"), F.desc("query_id"), F.col("token_usage_id").asc_nulls_first()).limit(n)


def recent(store: Store, n: int = 20, model: str | None = None) -> DataFrame:
    """Latest results as report lines."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("timestamp")
    return _latest(store, n, model).select(
        "test_no", "query_id", "model_name", stamp, "tool_calls", *REPORT_SCORES, "total_tokens"
    )


def by_model(store: Store, name: str, n: int = 20) -> DataFrame:
    return recent(store, n, name)


def detailed(store: Store, n: int = 10) -> DataFrame:
    return _latest(store, n).select(
        "test_no", "query_id", "model_name", "timestamp", F.col("query").alias("query_text"),
        F.col("direct_response").alias("response_text"), "tool_calls", *REPORT_SCORES,
        "total_tokens", "prompt_tokens", "completion_tokens",
    )


def models(store: Store) -> DataFrame:
    """Names of the models that have results, sorted."""
    used = store["query_result"].select("llm_model_id").distinct()
    return _models(store).join(used, "llm_model_id", "left_semi").select("model_name").distinct().orderBy("model_name")


def report(df: DataFrame, query_width: int = 200, response_width: int = 300) -> DataFrame:
    """Display form: scores to three places, texts cut, ``test_no`` first."""
    whole = {"query_id", "test_no", *TOKENS}
    cuts = {"query_text": query_width, "response_text": response_width}
    names = [c for c in ("test_no",) if c in df.columns] + [c for c in df.columns if c != "test_no"]
    kinds = dict(df.dtypes)
    out = []
    for name in names:
        col = F.col(name)
        if name in cuts:
            col = clip(col, cuts[name])
        elif kinds[name].startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm")
        elif kinds[name] in ("double", "float") and name not in whole:
            col = F.round(col, 3)
        out.append(col.alias(name))
    return df.select(*out)


def quick_summary(df: DataFrame, model: str = "model_name", ts: str = "timestamp", scores=REPORT_SCORES) -> DataFrame:
    return df.agg(
        F.countDistinct(model).alias("n_models"), *[F.avg(s).alias(f"avg_{s}") for s in scores],
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"),
    )


def run_metrics(df: DataFrame, scores=SCORES) -> DataFrame:
    """Mean of each score of a run, null where no row has it."""
    return df.agg(*[F.avg(s).alias(s) for s in scores])


def metric_columns(df: DataFrame, prefix: str = "") -> list[str]:
    """Numeric columns with a prefix that are neither ids nor numbers of a test."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [
        n for n, k in df.dtypes
        if (k in numeric or k.startswith("decimal")) and n.startswith(prefix)
        and n not in ("id", "test_no") and not n.endswith("_id")
    ]


def history(df: DataFrame, field: str, direction: str = "desc") -> DataFrame:
    """Sort by any field: numbers by value, then texts; nulls and bad times first ascending, last descending."""
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be 'asc' or 'desc'")
    order = (lambda c: c.asc_nulls_first()) if direction == "asc" else (lambda c: c.desc_nulls_last())
    text = F.col(field).cast("string")
    if field.endswith("timestamp"):
        return df.orderBy(order(F.try_to_timestamp(text)))
    number = text.try_cast("double")
    kind = F.when(text.isNull(), F.lit(None)).when(number.isNotNull(), 0).otherwise(1)
    return df.orderBy(order(kind), order(number), order(text))


def refresh_if_any(driving: DataFrame, refresh) -> bool:
    """Run ``refresh`` unless the driving table is empty."""
    if driving.isEmpty():
        return False
    refresh()
    return True


def resolve_model(df: DataFrame, llm_models: DataFrame, name: str = "llm_model") -> DataFrame:
    """Replace model names by ids; a name without a model is an error."""
    lookup = _renamed(llm_models, **{"llm_model_id": "id", name: "name"})
    unknown = df.select(name).distinct().join(lookup, name, "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown models: {sorted(str(r[0]) for r in unknown)}")
    return join_lookup(df, lookup, name).drop(name)


# Attempts and outcomes

# States of an attempt.
PENDING, RUNNING, SUCCESS, FAILED, EXHAUSTED = "pending", "running", "success", "failed", "max_retries_reached"


def last_attempts(log: DataFrame) -> DataFrame:
    keys = ["model_id", "test_case_id", "run_number"]
    return log.groupBy(*keys).agg(
        F.max_by(F.struct("attempt_status", "retry_count"), "attempt_ts").alias("last")
    ).select(*keys, "last.*")


def attempt_summary(log: DataFrame) -> DataFrame:
    """Runs per state, retries and distinct passed and failed tests per model."""
    last = last_attempts(log)
    count = lambda state: F.count_if(F.col("attempt_status") == state)
    # Per test first, so that the distinct tests are plain counts afterwards.
    per_test = last.groupBy("model_id", "test_case_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("retry_count").alias("retries"),
        *[count(s).alias(s) for s in (SUCCESS, EXHAUSTED, PENDING, RUNNING)],
    )
    return per_test.groupBy("model_id").agg(
        F.sum("runs").alias("total_tests"), F.sum(SUCCESS).alias("successful_tests"),
        F.sum(EXHAUSTED).alias("failed_tests"), F.sum(PENDING).alias("pending_tests"),
        F.sum(RUNNING).alias("running_tests"), F.sum("retries").alias("total_retries"),
        F.count_if(F.col(SUCCESS) > 0).alias("successful_test_ids"),
        F.count_if(F.col(EXHAUSTED) > 0).alias("failed_test_ids"),
    )


def attempt_ids(log: DataFrame) -> DataFrame:
    """The passed and the failed tests of each model, one row each."""
    last = last_attempts(log).filter(F.col("attempt_status").isin(SUCCESS, EXHAUSTED))
    return last.select("model_id", "test_case_id", "attempt_status").distinct()


def retry_histogram(log: DataFrame) -> DataFrame:
    return last_attempts(log).groupBy("model_id", "retry_count").agg(F.count(F.lit(1)).alias("n"))


def outcomes(df: DataFrame, response: str, score: str) -> DataFrame:
    """Every answer labelled scored, scoring_failed or call_failed."""
    label = F.when(is_error(F.coalesce(F.col(response), F.lit(""))) | F.col(response).isNull(), "call_failed").when(
        F.col(score).isNull(), "scoring_failed").otherwise("scored")
    return df.withColumn("outcome", label)


def outcome_counts(df: DataFrame, response: str, score: str) -> DataFrame:
    return outcomes(df, response, score).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def union_outcomes(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def combine(df: DataFrame, by: list[str], run: str, scores: list[str], mode: str = "mean") -> DataFrame:
    """Combine the scores of repeated runs.

    ``mean`` is the plain average. ``pairwise`` folds runs in order with
    ``(so far + next) / 2``, which weighs later runs more: the k-th of m runs has
    weight 2^-(m-k+1), the first 2^-(m-1). ``first`` takes the first run that has the score.
    """
    if mode == "mean":
        return df.groupBy(*by).agg(*[F.avg(s).alias(s) for s in scores])
    if mode == "first":
        return df.groupBy(*by).agg(*[F.min_by(s, F.when(F.col(s).isNotNull(), F.col(run))).alias(s) for s in scores])
    if mode != "pairwise":
        raise ValueError("mode must be 'mean', 'pairwise' or 'first'")

    # (so far + s) / 2 is the map x -> x / 2 + s / 2; begun at the first score itself, that score stays as it is.
    # A run without the score is the identity. All scores are folded at once, as rows.
    long = df.unpivot([*by, run], scores, "_score", "_value")
    there = F.col("_value").isNotNull()
    folded = scan.fold(
        long, [*by, "_score"], [run], F.when(there, F.lit(0.5)).otherwise(F.lit(1.0)), F.coalesce(F.col("_value") / 2, F.lit(0.0)),
        _first=F.min_by("_value", F.when(there, F.col(run))))
    # Composed maps round otherwise than a fold step by step: twelve places are the same in both.
    value = F.round(F.col("factor") * F.col("_first") + F.col("term"), 12)
    return folded.groupBy(*by).agg(*[F.max(F.when(F.col("_score") == s, value)).alias(s) for s in scores])


def token_usage(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Sum the per-call token arrays; a missing array counts as zero."""
    total = lambda name: F.coalesce(
        F.aggregate(F.col(metrics)[name], F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0))), F.lit(0))
    return df.withColumns({name: total(name) for name in ("prompt_tokens", "completion_tokens", "total_tokens")})


def distribution(cases: DataFrame, fields: list[str]) -> DataFrame:
    """Cases per value of each classification field, with their share."""
    counts = cases.unpivot([], fields, "field", "label").groupBy("field", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("_total"))
    # One row per listed field.
    return counts.join(F.broadcast(totals), "field").select(
        "field", "label", "n", (F.col("n") / F.col("_total") * 100).alias("share_pct")
    )


def extraction_rate(df: DataFrame, test: str, extracted: str, expected: str) -> DataFrame:
    """Share of exact extractions per test, and over all tests (null test)."""
    hit = F.when(F.col(expected) == 0, F.col(extracted) == 0).otherwise(F.col(extracted) == F.col(expected))
    value = F.coalesce(hit, F.lit(False)).cast("int")
    rows = df.select(F.col(test).alias("test"), value.alias("_hit"))
    return rows.rollup("test").agg(
        F.sum("_hit").alias("n_exact"), F.count(F.lit(1)).alias("n"), (F.avg("_hit") * 100).alias("rate_pct")
    )


def run_plan(cases: DataFrame, runs: Column | int) -> DataFrame:
    """(model_id, total): the runs planned per model, its test cases times the most runs of any of them."""
    runs = F.lit(runs) if isinstance(runs, int) else runs
    return cases.groupBy("model_id").agg((F.count_distinct("test_case_id") * F.max(runs)).alias("total"))


def progress(log: DataFrame, plan: DataFrame) -> DataFrame:
    """Finished runs, total, percent and retries per model; works on a stream of attempts too.

    ``plan`` is a table of (model_id, total). A run ends once, so the log has one finishing attempt for each;
    models without a plan have neither total nor percent.
    """
    done = F.count_if(F.col("attempt_status").isin(SUCCESS, EXHAUSTED))
    found = log.groupBy("model_id").agg(done.alias("done"), F.sum("retry_count").alias("retries"))
    return found.join(plan.select("model_id", F.col("total").cast("long").alias("total")), "model_id", "left").withColumn(
        "percent", percent_done(F.col("done"), F.col("total")))


# Quality of the store

FOREIGN_KEYS = (
    ("query_result", "llm_model_id", "llm_models"),
    ("query_evaluation", "query_result_id", "query_result"),
    ("query_evaluation", "evaluation_metrics_id", "evaluation_metrics"),
    ("token_usage", "query_result_id", "query_result"),
)


MODEL_TYPES = ("proprietary", "open source")  # fixed values


def constraint_audit(store: Store) -> DataFrame:
    """Violations of keys, uniqueness, the type domain and references, one row per constraint.

    Every table is read once. Its rows become marks (space, value, role): a key marks its own space, a reference
    the space of its parent. Marks are counted per value before they move, so a value that most rows
    refer to is one row per task, and all rules are read off the counts of one grouping.
    """
    def marks(name: str, df: DataFrame) -> DataFrame:
        mark = lambda space, col, role: F.struct(
            F.lit(space).alias("space"), F.col(col).cast("string").alias("value"), F.lit(role).alias("role"))
        own = ["id", "name", "type"] if name == "llm_models" else ["id"]
        out = [mark(f"{name}.{c}", c, "own") for c in own]
        out += [mark(f"{parent}.id", column, f"fk_{i}") for i, (child, column, parent) in enumerate(FOREIGN_KEYS) if child == name]
        return df.select(F.inline(F.array(*out)))

    roles = ["own", *[f"fk_{i}" for i in range(len(FOREIGN_KEYS))]]
    counts = reduce(DataFrame.unionByName, [marks(n, df) for n, df in store.items()]).groupBy("space", "value").agg(
        *[F.count_if(F.col("role") == r).alias(r) for r in roles])
    within = lambda space: F.col("space") == space
    total = lambda rows, n: F.coalesce(F.sum(F.when(rows, n)), F.lit(0)).cast("long")
    repeated = (F.col("own") > 1) | (F.col("value").isNull() & (F.col("own") > 0))
    rules = [(n, "primary key id", total(within(f"{n}.id") & repeated, F.lit(1))) for n in store]
    rules.append(("llm_models", "unique name", total(within("llm_models.name") & repeated, F.lit(1))))
    rules.append(("llm_models", "type domain", total(within("llm_models.type") & ~F.col("value").isin(*MODEL_TYPES), F.col("own"))))
    for i, (child, column, parent) in enumerate(FOREIGN_KEYS):
        orphans = within(f"{parent}.id") & F.col("value").isNotNull() & (F.col("own") == 0)
        rules.append((child, f"foreign key {column}", total(orphans, F.col(f"fk_{i}"))))
    found = counts.agg(*[n.alias(f"_{i}") for i, (_, _, n) in enumerate(rules)])
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations"))
        for i, (table, rule, _) in enumerate(rules)])))


def diagnostics(df: DataFrame, query_id: str, text: str, model: str) -> DataFrame:
    """Rows, distinct ids, texts and models."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(query_id).alias("n_ids"),
        F.countDistinct(text).alias("n_texts"), F.countDistinct(model).alias("n_models"),
    )


