"""Evaluation store: joins, reports, audits, attempts and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import text as tx
from fairlead.operators import ranks, reshape, stats, warehouse as w
from fairlead.operators import windows as win
from fairlead.plans import bindings as b
from fairlead.plans.registry import query
from fairlead.sources import sinks

W = f"WITH {b.STORE_SQL}"
A = f"WITH {b.ATTEMPTS_SQL}"
JOINED = """query_result qr JOIN query_evaluation qe ON qr.id = qe.query_result_id
  JOIN evaluation_metrics em ON qe.evaluation_metrics_id = em.id
  LEFT JOIN token_usage tu ON qr.id = tu.query_result_id JOIN llm_models m ON m.id = qr.llm_model_id"""
REPORT = """query_result qr JOIN llm_models m ON qr.llm_model_id = m.id
  LEFT JOIN query_evaluation qe ON qr.id = qe.query_result_id
  LEFT JOIN evaluation_metrics em ON qe.evaluation_metrics_id = em.id
  LEFT JOIN token_usage tu ON qr.id = tu.query_result_id"""
R4 = ", ".join(f"round({s}, 6) AS {s}" for s in w.REPORT_SCORES)
AVG4 = ", ".join(f"round(avg({s}), 6) AS avg_{s}" for s in w.REPORT_SCORES)


@query("J-1", f"""{W} SELECT qr.id AS query_result_id, qr.query, direct_response, full_response, sql_queries, tool_calls,
    qr.timestamp AS query_timestamp, em.id AS evaluation_metric_id, {", ".join(f"round({s}, 6) AS {s}" for s in w.SCORES)},
    m.name AS model_name, tu.id AS token_usage_id, prompt_tokens, completion_tokens, total_tokens
  FROM {JOINED}""")
def full_query_data(spark, d):
    return w.full_query_data(b.store(spark, d))


PERF = f"""SELECT m.id AS model_id, m.name AS model_name, m.type AS model_type,
    {", ".join(f"round(avg({s}), 6) AS avg_{s}, round(stddev_samp({s}), 6) AS stddev_{s}" for s in w.SCORES)},
    count(qe.id) AS query_evaluation_count, {", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in w.TOKENS)}
  FROM {JOINED}"""


@query("A-21", f"{W} {PERF} GROUP BY m.id, m.name, m.type")
def performance(spark, d):
    return w.performance(b.store(spark, d))


@query("J-2", f"""{W} SELECT qr.llm_model_id, count(*) AS n_rows, count(tu.id) AS n_token_rows, count(DISTINCT qr.id) AS n_results
  FROM {JOINED} GROUP BY 1""")
def performance_rows(spark, d):
    rows = w._scored(b.store(spark, d), "inner")
    return rows.groupBy("llm_model_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("token_usage_id").alias("n_token_rows"),
        F.countDistinct("query_result_id").alias("n_results"))


@query("P-19", f"{W} {PERF} WHERE m.type = 'proprietary' GROUP BY m.id, m.name, m.type")
def performance_of_type(spark, d):
    return w.performance(b.store(spark, d), "proprietary")


SUMMARY = f"""SELECT m.name AS model_name, m.type AS model_type, count(qr.id) AS query_evaluation_count, {AVG4},
    round(avg(total_tokens), 6) AS avg_total_tokens FROM {REPORT} GROUP BY m.id, m.name, m.type"""


@query("A-22", f"{W} {SUMMARY}")
def summary(spark, d):
    return w.summary(b.store(spark, d))


@query("T-6", f"""{W}, p AS ({SUMMARY}) SELECT *, row_number() OVER (ORDER BY model_name) AS place FROM p""")
def ordered_summary(spark, d):
    # The summary has one row per model, so this global order is small.
    from pyspark.sql import Window
    return w.summary(b.store(spark, d)).withColumn("place", F.row_number().over(Window.orderBy("model_name")))


@query("A-23", f"""{W} SELECT count(DISTINCT qr.id) AS total_queries, count(DISTINCT m.name) AS models_tested,
    min(qr.timestamp) AS earliest_test, max(qr.timestamp) AS latest_test, {AVG4}
  FROM query_result qr JOIN llm_models m ON qr.llm_model_id = m.id
  LEFT JOIN query_evaluation qe ON qr.id = qe.query_result_id
  LEFT JOIN evaluation_metrics em ON qe.evaluation_metrics_id = em.id""")
def statistics(spark, d):
    return w.statistics(b.store(spark, d))


@query("J-3", f"""{W} SELECT qr.id AS query_id, test_no, m.name AS model_name, {R4}, tu.id AS token_usage_id, total_tokens
  FROM {REPORT}""")
def report_rows(spark, d):
    return w.report_rows(b.store(spark, d)).select(
        "query_id", "test_no", "model_name", *w.REPORT_SCORES, "token_usage_id", "total_tokens")


RECENT = f"""SELECT test_no, qr.id AS query_id, m.name AS model_name, strftime(qr.timestamp, '%Y-%m-%d %H:%M') AS timestamp,
    tool_calls, {R4}, total_tokens FROM {REPORT}"""
NEWEST = "ORDER BY qr.timestamp DESC, qr.id DESC, tu.id NULLS FIRST"


@query("T-1", f"{W} {RECENT} {NEWEST} LIMIT 20")
def recent(spark, d):
    return w.recent(b.store(spark, d), 20)


@query("T-1-detailed", f"""{W} SELECT test_no, qr.id AS query_id, m.name AS model_name, qr.timestamp AS timestamp,
    query AS query_text, direct_response AS response_text, tool_calls, {R4}, total_tokens, prompt_tokens, completion_tokens
  FROM {REPORT} {NEWEST} LIMIT 10""")
def detailed(spark, d):
    return w.detailed(b.store(spark, d), 10)


@query("T-2", f"{W} {RECENT} WHERE m.name = 'src3' {NEWEST} LIMIT 20")
def by_model(spark, d):
    return w.by_model(b.store(spark, d), "src3", 20)


@query("T-3", f"{W} SELECT DISTINCT m.name AS model_name FROM llm_models m JOIN query_result qr ON m.id = qr.llm_model_id")
def models(spark, d):
    return w.models(b.store(spark, d))


@query("T-5", f"""{W} SELECT qr.id AS query_id, round(context_recall, 6) AS context_recall, total_tokens FROM {REPORT}""")
def history(spark, d):
    rows = w.report_rows(b.store(spark, d)).select("query_id", "context_recall", "total_tokens")
    return w.history(rows, "context_recall", "desc")


@query("A-24", f"""{W}, page AS (SELECT m.name, qr.timestamp, {", ".join(w.REPORT_SCORES)} FROM {REPORT} {NEWEST} LIMIT 200)
  SELECT count(DISTINCT name) AS n_models, {AVG4}, min(timestamp) AS first_at, max(timestamp) AS last_at FROM page""")
def quick_summary(spark, d):
    return w.quick_summary(w.detailed(b.store(spark, d), 200))


@query("A-25", f"""{W} SELECT {", ".join(f"round(avg({s}), 6) AS {s}" for s in w.SCORES)} FROM evaluation_metrics""")
def run_metrics(spark, d):
    return w.run_metrics(b.store(spark, d)["evaluation_metrics"])


def _cut(col, n):
    return f"CASE WHEN length({col}) > {n} THEN substring({col}, 1, {n}) || '...' ELSE {col} END"


@query("P-16", f"""{W} SELECT test_no, qr.id AS query_id, m.name AS model_name,
    strftime(qr.timestamp, '%Y-%m-%d %H:%M') AS timestamp, {_cut("query", 200)} AS query_text,
    {_cut("direct_response", 300)} AS response_text, {", ".join(f"round({s}, 3) AS {s}" for s in w.REPORT_SCORES)}, total_tokens
  FROM {REPORT}""")
def report(spark, d):
    rows = w.report_rows(b.store(spark, d)).select(
        "query_id", "model_name", "timestamp", F.col("query").alias("query_text"),
        F.col("direct_response").alias("response_text"), *w.REPORT_SCORES, "total_tokens", "test_no")
    return w.report(rows)


@query("P-17", f"""{W} SELECT name, CASE WHEN 'vendor/' || name LIKE '%/%' THEN split_part('vendor/' || name, '/', 2) END AS short,
    'Rogue Score' AS title FROM llm_models""")
def short_names(spark, d):
    return b.store(spark, d)["llm_models"].select(
        "name", tx.short_name(F.concat(F.lit("vendor/"), "name")).alias("short"), tx.title(F.lit("rogue_score")).alias("title"))


@query("P-18", f"""{W}, o AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM llm_models)
  SELECT name AS model, CASE name WHEN 'src1' THEN 'First' WHEN 'src2' THEN 'Second' ELSE 'Model ' || i END AS alias FROM o""")
def aliases(spark, d):
    names = b.store(spark, d)["llm_models"].select(F.col("name").alias("model"))
    return reshape.alias_models(names, "model", {"src1": "First", "src2": "Second"})


@query("P-20", f"""{W} SELECT {", ".join(f"round(avg({s}), 6) AS {s}" for s in w.SCORES)} FROM evaluation_metrics""")
def metric_columns(spark, d):
    metrics = b.store(spark, d)["evaluation_metrics"]
    return w.run_metrics(metrics, w.metric_columns(metrics))


@query("S-21", f"""{W} SELECT m.id AS model_id, m.name AS model_name, round(avg(faithfulness), 6) AS avg_faithfulness
  FROM {JOINED} GROUP BY 1, 2""")
def records(spark, d):
    rows = w.performance(b.store(spark, d)).select("model_id", "model_name", "avg_faithfulness")
    record = F.from_json("record", "model_id int, model_name string, avg_faithfulness double")
    return sinks.to_records(rows).select(record.alias("r")).select("r.*")


@query("J-10", f"{W} SELECT qr.id, m.id AS llm_model_id FROM query_result qr JOIN llm_models m ON m.id = qr.llm_model_id")
def resolve_model(spark, d):
    named = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("llm_model"))
    return w.resolve_model(named, b.store(spark, d)["llm_models"])


@query("J-12", "SELECT item_id, i AS run_number, 'pending' AS status FROM benchmark, (SELECT unnest([1, 2, 3]) AS i)")
def plan_runs(spark, d):
    return reshape.plan_runs(b.table(spark, d, "benchmark").select("item_id"), 3)


@query("J-14", f"{W} SELECT count(*) AS n FROM query_result WHERE EXISTS (SELECT 1 FROM query_result)")
def existence_guard(spark, d):
    results = b.store(spark, d)["query_result"]
    out = []
    w.refresh_if_any(results, lambda: out.append(results.agg(F.count(F.lit(1)).alias("n"))))
    return out[0]


@query("P-13", """SELECT item_id, CAST(position AS BIGINT) AS position FROM (
    SELECT item_id, row_number() OVER (ORDER BY item_id) AS position FROM benchmark)
  WHERE position IN (1, 3, 7, 8, 9, 10, 25)""")
def select_tests(spark, d):
    cases = b.table(spark, d, "benchmark").select("item_id")
    return reshape.select_tests(cases, "1,3,7-10, 25,x,9-8", "item_id")


@query("P-14", """SELECT outcome, count(*) AS n FROM (SELECT contains(text, 'TypeError:') OR contains(text, 'KeyError:')
    OR contains(text, 'IndexError:') OR contains(text, 'Error processing query')
    OR contains(text, '''NoneType'' object is not subscriptable') AS outcome FROM documents) GROUP BY 1""")
def error_predicate(spark, d):
    return b.table(spark, d, "documents").groupBy(tx.is_error(F.col("text")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


# Attempts, outcomes, runs


@query("A-26", f"""{A} SELECT model_id, count(*) AS total_tests, count(*) FILTER (attempt_status = 'success') AS successful_tests,
    count(*) FILTER (attempt_status = 'max_retries_reached') AS failed_tests,
    count(*) FILTER (attempt_status = 'pending') AS pending_tests, count(*) FILTER (attempt_status = 'running') AS running_tests,
    CAST(sum(retry_count) AS BIGINT) AS total_retries,
    count(DISTINCT test_case_id) FILTER (attempt_status = 'success') AS successful_test_ids,
    count(DISTINCT test_case_id) FILTER (attempt_status = 'max_retries_reached') AS failed_test_ids FROM last GROUP BY 1""")
def attempt_summary(spark, d):
    return w.attempt_summary(b.attempts(spark, d))


@query("A-26-ids", f"""{A} SELECT DISTINCT model_id, test_case_id, attempt_status FROM last
  WHERE attempt_status IN ('success', 'max_retries_reached')""")
def attempt_ids(spark, d):
    return w.attempt_ids(b.attempts(spark, d))


@query("A-26-retries", f"{A} SELECT model_id, retry_count, count(*) AS n FROM last GROUP BY 1, 2")
def retry_histogram(spark, d):
    return w.retry_histogram(b.attempts(spark, d))


@query("W-7", f"""{A} SELECT model_id, test_case_id, run_number, attempt_status, attempt_ts FROM last""")
def latest_status(spark, d):
    return win.latest_status(b.attempts(spark, d), ["model_id", "test_case_id", "run_number"], "attempt_status", "attempt_ts")


OUTCOME = """CASE WHEN contains(text, 'TypeError:') OR contains(text, 'KeyError:') OR contains(text, 'IndexError:')
    OR contains(text, 'Error processing query') OR contains(text, '''NoneType'' object is not subscriptable')
  THEN 'call_failed' WHEN quality IS NULL THEN 'scoring_failed' ELSE 'scored' END"""


@query("A-27", f"""SELECT {OUTCOME} AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def outcomes(spark, d):
    rows = b.table(spark, d, "documents").join(b.table(spark, d, "labels"), "doc_id", "left")
    return w.outcome_counts(rows, "text", "quality")


@query("R-2", """SELECT doc_id, quality, source FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, NULL, source FROM documents ANTI JOIN labels USING (doc_id)""")
def union_outcomes(spark, d):
    docs, labels = b.table(spark, d, "documents").select("doc_id", "source"), b.table(spark, d, "labels")
    scored = docs.join(labels.select("doc_id", "quality"), "doc_id")
    return w.union_outcomes(scored, docs.join(labels, "doc_id", "left_anti")).select("doc_id", "quality", "source")


RUNS = """runs AS (SELECT user_id, event_type, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, event_type) AS m
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))"""


@query("A-28", "SELECT user_id, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def combine_mean(spark, d):
    return w.combine(b.table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"])


@query("A-28-pairwise", f"""WITH RECURSIVE {RUNS}, fold AS (
    SELECT user_id, event_type, i, m, value AS acc FROM runs WHERE i = 1
    UNION ALL SELECT f.user_id, f.event_type, r.i, f.m, (f.acc + r.value) / 2 FROM fold f
      JOIN runs r ON r.user_id = f.user_id AND r.event_type = f.event_type AND r.i = f.i + 1)
  SELECT user_id, event_type, round(acc, 6) AS value FROM fold WHERE i = m""")
def combine_pairwise(spark, d):
    return w.combine(b.table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"], "pairwise")


@query("A-28-first", "SELECT user_id, event_type, round(arg_min(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def combine_first(spark, d):
    return w.combine(b.table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"], "first")


@query("A-29", """SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS prompt_tokens,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS completion_tokens, sum(length(text)) AS total_tokens
  FROM conversations GROUP BY 1""")
def token_usage(spark, d):
    n = F.length("text").cast("long")
    # A conversation is one agent run: its calls are few.
    calls = b.table(spark, d, "conversations").groupBy("conv_id").agg(F.struct(
        F.collect_list(F.when(F.col("role") == "user", n)).alias("prompt_tokens"),
        F.collect_list(F.when(F.col("role") == "assistant", n)).alias("completion_tokens"),
        F.collect_list(n).alias("total_tokens")).alias("metrics"))
    return w.token_usage(calls).drop("metrics")


@query("A-32", """WITH c AS (SELECT 'lang' AS field, lang AS label FROM documents UNION ALL SELECT 'source', source FROM documents),
  n AS (SELECT field, label, count(*) AS n FROM c GROUP BY 1, 2)
  SELECT field, label, n, round(n * 100.0 / sum(n) OVER (PARTITION BY field), 6) AS share_pct FROM n""")
def distribution(spark, d):
    return w.distribution(b.table(spark, d, "documents"), ["lang", "source"])


NUM = r"TRY_CAST(nullif(regexp_extract(text, '-?\d+(?:\.\d+)?'), '') AS DOUBLE)"


@query("A-33", f"""SELECT lang AS test, CAST(sum(hit) AS BIGINT) AS n_exact, count(*) AS n, round(avg(hit) * 100, 6) AS rate_pct FROM (
    SELECT lang, CASE WHEN coalesce({NUM} = doc_id % 10, false) THEN 1 ELSE 0 END AS hit FROM documents) GROUP BY ROLLUP (lang)""")
def extraction_rate(spark, d):
    rows = b.table(spark, d, "documents").select(
        "lang", tx.first_number(F.col("text")).alias("found"), (F.col("doc_id") % 10).cast("double").alias("expected"))
    return w.extraction_rate(rows, "lang", "found", "expected")


@query("F-15", b.PROGRESS_SQL)
def progress(spark, d):
    return w.progress(b.attempts(spark, d), b.planned_runs(spark, d))


# Audits


@query("C-7", f"""{W}, t AS (
    SELECT 'llm_models' AS "table", 'primary key id' AS rule, (SELECT count(*) FROM (SELECT id FROM llm_models GROUP BY id HAVING count(*) > 1)) AS violations
    UNION ALL SELECT 'query_result', 'primary key id', (SELECT count(*) FROM (SELECT id FROM query_result GROUP BY id HAVING count(*) > 1))
    UNION ALL SELECT 'query_evaluation', 'primary key id', (SELECT count(*) FROM (SELECT id FROM query_evaluation GROUP BY id HAVING count(*) > 1))
    UNION ALL SELECT 'evaluation_metrics', 'primary key id', (SELECT count(*) FROM (SELECT id FROM evaluation_metrics GROUP BY id HAVING count(*) > 1))
    UNION ALL SELECT 'token_usage', 'primary key id', (SELECT count(*) FROM (SELECT id FROM token_usage GROUP BY id HAVING count(*) > 1))
    UNION ALL SELECT 'llm_models', 'unique name', (SELECT count(*) FROM (SELECT name FROM llm_models GROUP BY name HAVING count(*) > 1))
    UNION ALL SELECT 'llm_models', 'type domain', (SELECT count(*) FROM llm_models WHERE type NOT IN ('proprietary', 'open source'))
    UNION ALL SELECT 'query_result', 'foreign key llm_model_id', (SELECT count(*) FROM query_result WHERE llm_model_id NOT IN (SELECT id FROM llm_models))
    UNION ALL SELECT 'query_evaluation', 'foreign key query_result_id', (SELECT count(*) FROM query_evaluation WHERE query_result_id NOT IN (SELECT id FROM query_result))
    UNION ALL SELECT 'query_evaluation', 'foreign key evaluation_metrics_id', (SELECT count(*) FROM query_evaluation WHERE evaluation_metrics_id NOT IN (SELECT id FROM evaluation_metrics))
    UNION ALL SELECT 'token_usage', 'foreign key query_result_id', (SELECT count(*) FROM token_usage WHERE query_result_id NOT IN (SELECT id FROM query_result)))
  SELECT * FROM t""")
def constraint_audit(spark, d):
    return w.constraint_audit(b.store(spark, d))


SCORES = f"""scores AS (SELECT qr.query, m.name AS model, em.* EXCLUDE (id) FROM query_result qr
  JOIN llm_models m ON m.id = qr.llm_model_id JOIN query_evaluation qe ON qe.query_result_id = qr.id
  JOIN evaluation_metrics em ON em.id = qe.evaluation_metrics_id)"""
MEANS = f"{SCORES}, means AS (SELECT query, model, round(avg(semantic_similarity), 12) AS v FROM scores GROUP BY 1, 2)"
COMPLETE = f"""{MEANS}, full_rows AS (SELECT * FROM means WHERE query IN (
  SELECT query FROM means GROUP BY 1 HAVING count(v) = (SELECT count(DISTINCT model) FROM scores)))"""


def _scores(spark, d):
    return w.scores(b.store(spark, d)).withColumnRenamed("model_name", "model")


@query("C-8", f"""{W}, {MEANS} SELECT model, (SELECT count(DISTINCT query) FROM scores) - count(v) AS n_missing FROM means GROUP BY 1""")
def missing_report(spark, d):
    return reshape.missing_report(_scores(spark, d), "query", "model", "semantic_similarity")


@query("C-9", f"""{W} SELECT count(*) AS n_rows, count(DISTINCT qr.id) AS n_ids, count(DISTINCT query) AS n_texts,
    count(DISTINCT m.name) AS n_models FROM {REPORT}""")
def diagnostics(spark, d):
    return w.diagnostics(w.report_rows(b.store(spark, d)), "query_id", "query", "model_name")


# Reshaping and statistics of scores

MODELS = [f"src{i}" for i in range(20)]


@query("R-4", f"""{W}, {COMPLETE} SELECT query, {", ".join(f"round(max(v) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS)}
  FROM full_rows GROUP BY 1""")
def score_matrix(spark, d):
    return reshape.score_matrix(_scores(spark, d), "query", "model", "semantic_similarity", MODELS)


@query("R-5", f"""{W}, p AS ({PERF} GROUP BY m.id, m.name, m.type)
  {" UNION ALL ".join(f"SELECT model_name, '{s}' AS metric, avg_{s} AS avg, stddev_{s} AS stddev FROM p" for s in w.SCORES)}""")
def melt_metrics(spark, d):
    return reshape.melt_metrics(w.performance(b.store(spark, d)), ["model_name"], list(w.SCORES))


@query("R-6", f"""{W}, {SCORES} {" UNION ALL ".join(
    f"SELECT model, '{s}' AS metric, round({s}, 6) AS value FROM scores" for s in w.SCORES)}""")
def melt(spark, d):
    return reshape.melt(_scores(spark, d).drop("query"), ["model"], list(w.SCORES))


@query("R-7", f"{W} SELECT a.name AS name_1, b.name AS name_2 FROM llm_models a JOIN llm_models b ON a.name < b.name")
def pairs(spark, d):
    return reshape.pairs(b.store(spark, d)["llm_models"], "name")


@query("R-8", f"{W} SELECT id, round(rogue_score, 6) AS rouge_score FROM evaluation_metrics")
def rename(spark, d):
    return reshape.rename(b.store(spark, d)["evaluation_metrics"].select("id", "rogue_score"))


@query("W-5", f"""{W}, {COMPLETE} SELECT query, model, round(v, 6) AS semantic_similarity,
    count(*) OVER (PARTITION BY query, v) AS n_tied,
    rank() OVER (PARTITION BY query ORDER BY v) + (count(*) OVER (PARTITION BY query, v) - 1) / 2 AS rank FROM full_rows""")
def avg_rank(spark, d):
    full = reshape.complete_scores(_scores(spark, d), "query", "model", "semantic_similarity")
    return ranks.avg_rank(full, ["query"], "semantic_similarity")


@query("W-9", f"""{W} SELECT name, CASE name WHEN 'src7' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END AS rank FROM llm_models""")
def preferred_order(spark, d):
    return win.preferred_order(b.store(spark, d)["llm_models"].select("name"), "name", ["src7", "src2"])


@query("A-30", f"""{W}, {SCORES} SELECT model, count(semantic_similarity) AS n, round(avg(semantic_similarity), 6) AS mean,
    round(median(semantic_similarity), 6) AS median, round(stddev_pop(semantic_similarity), 6) AS std FROM scores GROUP BY 1""")
def describe(spark, d):
    return ranks.describe(_scores(spark, d), ["model"], "semantic_similarity")


BOX = """q AS (SELECT model, count(v) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3
  FROM (SELECT model, semantic_similarity AS v FROM scores) GROUP BY 1),
  x AS (SELECT q.*, semantic_similarity AS v, semantic_similarity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
    FROM scores JOIN q USING (model) WHERE semantic_similarity IS NOT NULL)"""


@query("A-31", f"""{W}, {SCORES}, {BOX} SELECT model, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    round(min(v) FILTER (inside), 6) AS whisker_low, round(max(v) FILTER (inside), 6) AS whisker_high,
    count(*) FILTER (NOT inside) AS n_outliers FROM x GROUP BY ALL""")
def boxplot(spark, d):
    return ranks.boxplot(_scores(spark, d), ["model"], "semantic_similarity")


def _ranked_sql(metric):
    return f"""SELECT '{metric}' AS metric, query, model, v, rank() OVER (PARTITION BY query ORDER BY v)
        + (count(*) OVER (PARTITION BY query, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY query, v) AS t
      FROM (SELECT query, model, round(avg({metric}), 12) AS v FROM scores GROUP BY 1, 2)
      WHERE query IN (SELECT query FROM (SELECT query, model, round(avg({metric}), 12) AS v FROM scores GROUP BY 1, 2)
                      GROUP BY 1 HAVING count(v) = (SELECT count(DISTINCT model) FROM scores))"""


RANKED = f"ranked AS ({' UNION ALL '.join(_ranked_sql(s) for s in w.SCORES)})"
FRIEDMAN = f"""{RANKED}, sums AS (SELECT metric, model, sum(r) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM ranked GROUP BY 1, 2),
  tests AS (SELECT metric, max(n) AS n, count(*) AS k,
      (12 / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(n) * (count(*) + 1))
      / nullif(1 - sum(ties) / (max(n) * count(*) * (count(*) * count(*) - 1)), 0) AS statistic FROM sums GROUP BY 1)"""


@query("X-1", f"""{W}, {SCORES}, {FRIEDMAN} SELECT metric, round(statistic, 6) AS statistic, n, k FROM tests WHERE n >= 2""")
def friedman(spark, d):
    scores = _scores(spark, d).unpivot(["query", "model"], list(w.SCORES), "metric", "score")
    tests = stats.friedman(scores, "query", "model", "score", "metric")
    return tests.filter(F.col("error").isNull()).select("metric", "statistic", "n", "k")


@query("X-2", f"""{W}, {SCORES}, {RANKED}, r AS (SELECT metric, model, avg(r) AS mr, count(*) AS n FROM ranked GROUP BY 1, 2)
  SELECT a.metric, a.model AS model_1, b.model AS model_2, round(abs(a.mr - b.mr) / sqrt(20 * 21 / (6 * a.n)), 6) AS q
  FROM r a JOIN r b ON a.metric = b.metric AND a.model < b.model""")
def nemenyi(spark, d):
    scores = _scores(spark, d).unpivot(["query", "model"], list(w.SCORES), "metric", "score")
    return stats.nemenyi(stats.rank_sums(scores, "query", "model", "score", "metric"), "model").drop("p_value")


@query("X-3", f"""{W}, {COMPLETE}, dd AS (SELECT a.model AS model_1, b.model AS model_2, round(a.v - b.v, 12) AS d
    FROM full_rows a JOIN full_rows b ON a.query = b.query AND a.model < b.model),
  r AS (SELECT *, rank() OVER (PARTITION BY model_1, model_2 ORDER BY abs(d))
      + (count(*) OVER (PARTITION BY model_1, model_2, abs(d)) - 1) / 2 AS r FROM dd WHERE d <> 0)
  SELECT model_1, model_2, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, count(r) AS n
  FROM (SELECT DISTINCT model_1, model_2 FROM dd) LEFT JOIN r USING (model_1, model_2) GROUP BY 1, 2""")
def wilcoxon(spark, d):
    tests = stats.wilcoxon_pairs(_scores(spark, d), "query", "model", "semantic_similarity")
    return tests.select("model_1", "model_2", "w", "n")


# The tail of the chi-square distribution as a finite sum; for odd degrees of freedom with the error function by Simpson's rule.
TAIL = """CASE WHEN statistic IS NULL THEN NULL WHEN statistic <= 0 THEN 1.0
    WHEN df % 2 = 0 THEN list_sum(list_transform(range(0, df // 2), lambda i: exp(i * ln(statistic / 2) - lgamma(i + 1) - statistic / 2)))
    ELSE coalesce(list_sum(list_transform(range(1, (df - 1) // 2 + 1),
        lambda i: exp((i - 0.5) * ln(statistic / 2) - lgamma(i + 0.5) - statistic / 2))), 0)
      + 2 / sqrt(pi()) * 8 / 4000 / 3 * list_sum(list_transform(range(0, 4001),
        lambda j: (CASE WHEN j IN (0, 4000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(sqrt(statistic / 2) + j * 8 / 4000, 2)))) END"""


@query("X-4", f"""{W}, {SCORES}, {FRIEDMAN},
  width AS (SELECT unnest({list(w.SCORES)}) AS metric, k FROM (SELECT count(DISTINCT model) AS k FROM scores)),
  x AS (SELECT w.metric, w.k, CAST(w.k - 1 AS INTEGER) AS df, coalesce(t.n, 0) AS n,
      CASE WHEN coalesce(t.n, 0) < 2 OR w.k < 2 THEN 'Not enough data for Friedman test'
        WHEN w.k < 3 THEN 'At least 3 sets of samples must be given' END AS error, t.statistic
    FROM width w LEFT JOIN tests t USING (metric)),
  y AS (SELECT * REPLACE (CASE WHEN error IS NULL THEN statistic END AS statistic) FROM x),
  z AS (SELECT *, {TAIL} AS p FROM y)
  SELECT metric, round(statistic, 6) AS statistic, round(p, 6) AS p_value, n, k, error, coalesce(p < 0.05, false) AS significant FROM z""")
def compare_all(spark, d):
    return stats.compare_all(_scores(spark, d), "query", "model", list(w.SCORES))
