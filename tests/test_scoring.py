"""Metrics, text functions, store, sources and significance tests on hand-made rows."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.functions import metrics as mt
from fairlead.functions import tails
from fairlead.functions import text as tx
from fairlead.functions.metrics import STEM_FROM
from fairlead.functions.stems import IRREGULAR, STEP_2, STEP_3, STEP_4, stem
from fairlead.operators import reshape, scan, scoring, stats, warehouse, windows
from fairlead.plans.text_queries import _stem_ctes
from fairlead.sources import catalog, files, sinks, store


def values(spark, rows, schema, *cols):
    return [r[0] if len(r) == 1 else tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_bleu():
    words = "the cat sat on the mat today".split()
    assert mt.bleu(" ".join(words), " ".join(words)) == pytest.approx(1.0)
    assert mt.bleu("", "a b") == 0.0 and mt.bleu("x y", "a b") == 0.0
    # Three words: no 4-gram, a denominator of one, the smoothed numerator.
    assert mt.bleu("a b c", "a b c") == pytest.approx(0.1 ** 0.25)
    assert mt.bleu("a b c", "a b c", smooth=False) < 1e-70
    assert mt.bleu("a b c d", "a b c d e f") == pytest.approx(math.exp(1 - 6 / 4))


def test_rouge_l_matches_plain_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(2))
        x, y = a.split(), b.split()
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
        common = table[-1][-1]
        want = 2 * common / (len(x) + len(y)) if common else 0.0
        assert mt.rouge_l(a, b) == pytest.approx(want)


# Stems published with the rules.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "enjoy": "enjoy",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "triplicate": "triplic",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "dying": "die", "is": "is", "by": "by",
}


def test_stems():
    assert {word: stem(word) for word in STEMS} == STEMS


def test_stems_equal_check_sql():
    rng = random.Random(8)
    ends = [s for s, _ in (*STEP_2, *STEP_3)] + [*STEP_4, "s", "ies", "sses", "ed", "eed", "ied", "ing", "y", "ly", "e", "ll", "logi", "alli", "3", ""]
    words = {"".join(rng.choice("abeilostyz") for _ in range(rng.randint(0, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing", "e"])
             for _ in range(20_000)} | set(STEMS) | set(IRREGULAR)
    words = sorted(w for w in words if len(w) >= STEM_FROM and "yy" not in w)
    con = duckdb.connect()
    con.register("words", pd.DataFrame({"w": words}))
    got = con.execute("WITH rw AS (SELECT w, 0 AS item_id, 0 AS i FROM words), sw AS (SELECT w, 0 AS id, 0 AS item_id, 0 AS i FROM words), "
                      + _stem_ctes()[0].rstrip(" ,\n") + " SELECT w0, w FROM stem").fetchall()
    assert len(got) == len(words) > 10_000
    assert [(w, s, stem(w)) for w, s in got if s != stem(w)] == []


def test_rouge_of_stems_matches_plain_table():
    rng = random.Random(6)
    words = [*STEMS, "the", "was", "cats", "hopes", "rated", "rates"]
    for _ in range(200):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(2))
        x, y = ([stem(w) if len(w) > 3 else w for w in t.split()] for t in (a, b))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
        assert mt.rouge_l(a, b, stems=True) == pytest.approx(2 * table[-1][-1] / (len(x) + len(y)))
    assert mt.rouge_l("Hoping cats", "hoped cat", stems=True) == 1.0 and mt.rouge_l("Hoping cats", "hoped cat") == 0.0
    assert mt.rouge_l(None, "x", stems=True) == 0.0


def test_similarity_matches_builtin(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("aéb日") for _ in range(rng.randint(0, 9))),
             "".join(rng.choice("aéb日") for _ in range(rng.randint(0, 70)))) for _ in range(300)] + [("", "")]
    found = spark.createDataFrame(rows, "a string, b string").select(
        mt.string_similarity(F.col("a"), F.col("b")).alias("s"), F.levenshtein("a", "b").alias("d"),
        F.greatest(F.length("a"), F.length("b")).alias("n")).collect()
    assert all(r.s == pytest.approx(1 - r.d / r.n if r.n else 1.0) for r in found)


def test_answer_sections(spark):
    rows = [
        ("## Answer\none\n## Answer\n two \n### Detail\nx", "two"),
        ("## Answer\n### Head\nbody\n## Next", ""),
        ("intro Agent Reasoning and Response: ## Key Details of it\nvalue 5\n## Other", "of it\nvalue 5"),
        ("## Analysis\na\n## Analysis\n result ", "result"),
        ("plain", "plain"), ("   ", ""), (None, None),
    ]
    found = values(spark, [(r, i) for i, (r, _) in enumerate(rows)], "r string, i int", tx.extract_answer(F.col("r")))
    assert found == [w for _, w in rows]


def test_numbers(spark):
    rows = [("The cost is 254.67 SEK",), ("No numbers here",), ("",), (None,), ("used 12709.34 l and 254186.70 SEK",)]
    found = values(spark, rows, "t string", tx.first_number(F.col("t")), tx.all_numbers(F.col("t")))
    assert found == [(254.67, [254.67]), (None, []), (None, []), (None, []), (12709.34, [12709.34, 254186.70])]
    cleaned = values(spark, [("**-3.5 SEK**",), ("None",), ("1.2.3",), (None,)], "t string", tx.clean_number(F.col("t")))
    assert cleaned == [3.5, None, None, None]


def test_selection(spark):
    rows = [("1,3,7-10",), ("x, 2 ,5-",), ("9-8,-4",), (None,), ("3,1-3",)]
    found = values(spark, rows, "t string", tx.parse_selection(F.col("t")))
    assert found == [[1, 3, 7, 8, 9, 10], [2], [], [], [1, 2, 3]]


def test_stored_statements(spark):
    rows = [('{"a","b, c"}',), ('["x", "y"]',), ("SELECT 1",), ("",), (None,)]
    found = values(spark, rows, "t string", tx.parse_statements(F.col("t")))
    assert found == [["a", "b, c"], ["x", "y"], ["SELECT 1"], [], []]


def test_scores_and_labels(spark):
    row = spark.range(1).select(
        tx.relative_score(F.lit(764.43), F.lit(743.98)).alias("near"), tx.relative_score(F.lit(0.0), F.lit(0.0)).alias("same"),
        tx.relative_score(F.lit(9.0), F.lit(1.0)).alias("far"), tx.or_else(F.lit(0.0), F.lit(None).cast("double")).alias("zero"),
        tx.or_else(F.lit(0.0), F.lit(0.4)).alias("second"), tx.title(F.lit("rogue_score")).alias("title"),
        tx.format_deviation(F.lit(None).cast("double")).alias("na"), tx.percent_done(F.lit(2), F.lit(3)).alias("done")).first()
    assert row.near == pytest.approx(1 - 20.45 / 743.98) and row.same == 1.0 and row.far == 0.0
    assert (row.zero, row.second, row.title, row.na, row.done) == (0.0, 0.4, "Rogue Score", "N/A", 66)


def test_score_job(spark):
    answers = spark.createDataFrame([(1, "it was 200 SEK", " truth "), (2, None, "truth"), (3, "TypeError: x", "unknown")],
                                    "query_result_id int, response string, reference string")
    cases = spark.createDataFrame([("truth\n", " 250.0")], "ground_truth string, extracted_true_value string")
    rows = {r.query_result_id: r for r in scoring.run_record(scoring.score(answers, cases)).collect()}
    assert rows[1].factual_correctness == pytest.approx(0.8) and rows[1].call_ok and rows[1].scored_ok
    assert rows[2].factual_correctness is None and not rows[2].call_ok
    assert not rows[3].call_ok and rows[3].bleu_score is None
    with pytest.raises(ValueError):
        scoring.add_scores(answers.drop("reference"), ["bleu_score"])


@pytest.mark.parametrize("task_rows", [0, 2, 500_000])
def test_log_statements(spark, task_rows, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", task_rows)
    lines = ["noise", "INFO Running: SELECT 1", "  FROM t ", "", "INFO done", "Running: ", "lost", "Running: SELECT 2"]
    log = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "session_id long, line_no int, line string")
    found = windows.extract_sql(log).orderBy("first_line").collect()
    assert [r.sql for r in found] == ["SELECT 1 FROM t", "SELECT 2"]


def test_pairwise_combination(spark):
    runs = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 0.0), ("t", 3, 1.0), ("t", 4, None)], "t string, r int, s double")
    found = {m: warehouse.combine(runs, ["t"], "r", ["s"], m).first().s for m in ("mean", "first", "pairwise")}
    assert found == {"mean": pytest.approx(2 / 3), "first": 1.0, "pairwise": 0.75}


def scores(spark):
    table = {"q1": (1, 2, 3), "q2": (1, 3, 2), "q3": (1, 2, 2), "q4": (2, 1, 3)}
    rows = [(q, m, float(v)) for q, vs in table.items() for m, v in zip("abc", vs)] + [("q5", "a", 1.0)]
    return spark.createDataFrame(rows, "query string, model string, score double")


def test_friedman(spark):
    sums = {r.model: r.rank_sum for r in stats.rank_sums(scores(spark), "query", "model", "score").collect()}
    # Four complete blocks; ranks in each add up to six.
    assert sums == {"a": 5.0, "b": 8.5, "c": 10.5} and sum(sums.values()) == 4 * 6
    row = stats.friedman(scores(spark), "query", "model", "score").first()
    raw = 12 / (4 * 3 * 4) * (25 + 72.25 + 110.25) - 3 * 4 * 4
    want = raw / (1 - 6 / (4 * 3 * 8))
    assert row.n == 4 and row.k == 3 and row.error is None
    assert row.statistic == pytest.approx(want) and row.p_value == pytest.approx(math.exp(-want / 2))
    two = scores(spark).filter("model <> 'c'")
    assert stats.friedman(two, "query", "model", "score").first().error is not None


def test_wilcoxon(spark):
    rows = [(f"q{i}", m, v) for i, (x, y) in enumerate([(5, 1), (9, 3), (2, 4), (8, 7), (6, 6)]) for m, v in (("a", float(x)), ("b", float(y)))]
    df = spark.createDataFrame(rows, "query string, model string, score double")
    row = stats.wilcoxon_pairs(df, "query", "model", "score").first()
    # |d| 4, 6, 2, 1: the one fall has rank two; a zero rules the exact law out.
    assert row.n == 4 and row.w == 2.0
    assert row.p_value == pytest.approx(math.erfc(abs((2 - 5) / math.sqrt(4 * 5 * 9 / 24)) / math.sqrt(2)))
    exact = stats.wilcoxon_pairs(df.filter("query <> 'q4'"), "query", "model", "score").first()
    assert exact.p_value == pytest.approx(2 * 3 / 16)


def test_tails():
    assert tails.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi_square_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert tails.chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05)
    # Tabled critical values of the studentized range for infinite degrees of freedom.
    assert tails.studentized_range_tail(3.314, 3) == pytest.approx(0.05, abs=2e-4)
    assert tails.studentized_range_tail(3.858, 5) == pytest.approx(0.05, abs=2e-4)
    assert tails.signed_rank_exact(0, 5) == pytest.approx(2 / 32)


def test_nemenyi_q(spark):
    ranks = stats.rank_sums(scores(spark), "query", "model", "score")
    row = stats.nemenyi(ranks, "model").filter("model_1 = 'a' AND model_2 = 'c'").first()
    assert row.q == pytest.approx((10.5 - 5) / 4 / math.sqrt(3 * 4 / 24)) and 0 < row.p_value < 0.5


def test_fan_out_round_trip(spark, tmp_path):
    wide = [(1, None, "0.5", True), (2, 77, "n/a", False)]
    df = spark.createDataFrame(wide, "key long, existing_query_result_id long, factual_correctness string, tokens boolean").select(
        "*", F.lit(3).alias("llm_model_id"), *[F.lit("x").alias(c) for c in (
            "query", "direct_response", "full_response", "sql_queries", "tool_calls", "retrieved_contexts", "ground_truth")],
        F.lit(1).alias("test_no"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        *[F.lit(None).cast("double").alias(s) for s in warehouse.SCORES[1:]],
        F.when(F.col("tokens"), F.struct(F.lit(1.0).alias("prompt_tokens"), F.lit(2.0).alias("completion_tokens"),
                                         F.lit(3.0).alias("total_tokens"))).alias("token_usage"))
    parts = store.fan_out(df, "key")
    parts["llm_models"] = spark.createDataFrame([(3, "m", "open source")], "id int, name string, type string")
    store.append(parts, str(tmp_path))
    held = store.read_store(spark, str(tmp_path))
    assert {n: d.count() for n, d in held.items()} == {
        "llm_models": 1, "query_result": 1, "query_evaluation": 2, "evaluation_metrics": 2, "token_usage": 1}
    assert sorted((r.factual_correctness is None) for r in held["evaluation_metrics"].collect()) == [False, True]
    assert warehouse.performance(held).first().avg_factual_correctness == 0.5
    bad = {r.rule: r.violations for r in warehouse.constraint_audit(held).filter("violations > 0").collect()}
    assert bad == {"foreign key query_result_id": 1}  # the reused result is not in this store


def test_registration(spark, tmp_path):
    (tmp_path / "ships.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "trips.csv").write_text("a,b\n1,x\n")
    model = {"tables": [{"name": "ships-info", "path": "data/ships"}, {"name": "trips-data", "path": "trips.csv"}]}
    here = {"data_dir": str(tmp_path)}
    assert catalog.register(spark, model, "ships_info", replace=True, **here) == "ships_info"
    assert spark.table("ships_info").count() == 2
    assert catalog.register(spark, model, "main_data", replace=True, source_file="trips.csv", **here) == "data"
    # An existing view stays unless it is replaced.
    catalog.register(spark, model, "data", path="ships", **here)
    assert spark.table("data").columns == ["a", "b"]
    assert catalog.apply_op(spark.table("data"), "count").first()[0] == 1
    with pytest.raises(ValueError):
        catalog.apply_op(spark.table("data"), "eval")


def test_trip_csv_and_sinks(spark, tmp_path):
    (tmp_path / "trips.csv").write_text(
        "route_id,trip_type,time_departure,cars_outbound,fuelcons_outbound_l,start_time_outbound\n"
        "1,ordinary      ,2024-01-05 08:00:00,3.0,nan,2024-13-01 00:00:00\n")
    row = files.read_trips(spark, str(tmp_path / "trips.csv")).first()
    assert (row.route_id, row.trip_type, row.cars_outbound, row.fuelcons_outbound_l, row.start_time_outbound) == (1, "ordinary", 3, None, None)
    df = spark.createDataFrame([(1, "q", "r", ["s"])], "id int, query string, response string, sql_queries array<string>")
    sinks.write_archive(df, str(tmp_path / "archive"), "id")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "archive")).collect())
    assert "QUERY:" in text and "--- Query 1 ---" in text
    assert sinks.to_records(spark.sql("SELECT CAST(1.5 AS DECIMAL(3,1)) AS avg_x, NULL AS y")).first()[0] == '{"avg_x":1.5,"y":null}'


def test_registries(spark, tmp_path):
    (tmp_path / "fleet.json").write_text("""{"alpha": {"ship_no": "7", "breadth_m": 9.5, "machinery": {"engines":
        [{"type": "d", "power_kw": 100, "year_manufactured": 1990}], "propulsion": []}}, "beta": {"ship_no": "8"}}""")
    fleet = files.read_fleet(spark, str(tmp_path / "fleet.json"), "ship_no")
    assert {r.name: r.vessel_id for r in fleet.collect()} == {"alpha": "7", "beta": "8"}
    assert sorted((r.name, r.power_kw) for r in files.fleet_engines(fleet).collect()) == [("alpha", 100.0), ("beta", None)]
    (tmp_path / "routes.json").write_text('{"routes": [{"route_name": "R", "ferries": ["a"], "ferry_line_length_m": 900}]}')
    assert files.read_routes(spark, str(tmp_path / "routes.json")).first().ferry_line_length_m == 900
    (tmp_path / "slots.csv").write_text("Timestamp,Route\n06:30,A_B\na\n24:00,A_B\n")
    assert sorted(r.slot for r in files.read_timetable(spark, str(tmp_path / "slots.csv")).collect()) == [23_400.0, 86_400.0]
    (tmp_path / "wide.csv").write_text("Hour,Eve,Day,Remarks\n05,10,,x\n06,,40,\n")
    found = {(r.Hour, r.holiday): r.departures for r in files.read_holiday_timetable(spark, str(tmp_path / "wide.csv")).collect()}
    assert found == {("05", "Eve"): "10", ("06", "Day"): "40"}


def test_pivot_and_matrix(spark):
    wide = reshape.score_matrix(scores(spark), "query", "model", "score", ["a", "b", "c"])
    assert {r.query for r in wide.collect()} == {"q1", "q2", "q3", "q4"}
    missing = {r.model: r.n_missing for r in reshape.missing_report(scores(spark), "query", "model", "score").collect()}
    assert missing == {"a": 0, "b": 1, "c": 1}


def test_audit_reads_each_table_once(spark, tmp_path):
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    table("llm_models", [(1, "a", "open source"), (2, "a", None), (2, "b", "rented"), (None, None, "proprietary")], "id int, name string, type string")
    table("query_result", [("q1", 1), ("q2", 9), ("q2", None), ("q3", 9)], "id string, llm_model_id int")
    table("query_evaluation", [("e1", "q1", "m1"), ("e2", "q9", None), ("e3", None, "m7")],
          "id string, query_result_id string, evaluation_metrics_id string")
    table("evaluation_metrics", [("m1",), (None,), (None,)], "id string")
    table("token_usage", [("t1", "q3")] * 3, "id string, query_result_id string")
    held = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("llm_models", "query_result", "query_evaluation", "evaluation_metrics", "token_usage")}
    audit = warehouse.constraint_audit(held)
    assert {(r.table, r.rule): r.violations for r in audit.collect()} == {
        ("llm_models", "primary key id"): 2, ("query_result", "primary key id"): 1, ("query_evaluation", "primary key id"): 0,
        ("evaluation_metrics", "primary key id"): 1, ("token_usage", "primary key id"): 1, ("llm_models", "unique name"): 2,
        ("llm_models", "type domain"): 1, ("query_result", "foreign key llm_model_id"): 2,
        ("query_evaluation", "foreign key query_result_id"): 1, ("query_evaluation", "foreign key evaluation_metrics_id"): 1,
        ("token_usage", "foreign key query_result_id"): 0}
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 5 and plan.count("Aggregate [space") == 1
    empty = warehouse.constraint_audit({n: df.limit(0) for n, df in held.items()})
    assert [r.violations for r in empty.collect()] == [0] * 11


def test_edit_distance_steps_over_the_shorter_text():
    """As many steps as the shorter text has characters: a long answer costs little more than a short one."""
    import time

    from fairlead.functions.metrics import edit_distance

    long = "the quick brown fox jumps over the lazy dog " * 5_000
    start = time.process_time()
    assert edit_distance(long, "quick dog") == len(long) - len("quick dog")
    assert edit_distance("kitten" * 3, "sitting") == edit_distance("sitting", "kitten" * 3)
    assert time.process_time() - start < 0.15


def test_short_batches_for_answers(spark, tmp_path):
    """Few answers at a time go to Python, and few stems are remembered there."""
    from fairlead.functions.stems import stem
    from fairlead.plans import bindings

    for name, rows, schema in (("benchmark", [(0, "a b")], "item_id long, text string"),
                               ("documents", [(1, "a", "en", "src1", 1)], "doc_id long, text string, lang string, source string, n_chars long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bindings.answers(spark, str(tmp_path)).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert stem.cache_info().maxsize <= 20_000
