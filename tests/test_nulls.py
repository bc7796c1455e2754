"""Null keys and times keep their rows, in chunked and in plain form alike."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fairlead.operators import asof, graph, scan, scoring, windows

T = dt.datetime(2024, 1, 1, 23, 59)


@pytest.fixture(scope="module")
def rows(spark):
    step = lambda m: T + dt.timedelta(minutes=m)
    return spark.createDataFrame(
        [("a", step(0), 1), ("a", step(2), 2), (None, step(0), 3), (None, step(3), 4), ("b", None, 5), ("b", step(1), 6)],
        "k string, ts timestamp_ntz, v int")


@pytest.mark.parametrize("task_rows", [0, 1, 500_000])
def test_windows_keep_null_groups(rows, task_rows, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", task_rows)
    pick = lambda df: sorted(map(tuple, df.select("v", "before").collect()))
    assert pick(windows.with_previous(rows, ["k"], "ts", {"v": "before"})) == [(1, None), (2, 1), (3, None), (4, 3), (5, None), (6, 5)]
    sums = windows.running_sum(rows, ["k"], ["ts"], F.col("v"), "s").select("v", "s").collect()
    assert sorted(map(tuple, sums)) == [(1, 1), (2, 3), (3, 3), (4, 7), (5, 5), (6, 11)]


def test_null_keys_match_nothing_as_of(spark, rows):
    right = spark.createDataFrame([("a", T, 7), (None, T, 8)], "k string, at timestamp_ntz, p int")
    got = asof.asof_nearest(rows, right, ["k"], "ts", "at", 60.0, ["p"], "p")
    assert sorted(map(tuple, got.select("v", "p").collect())) == [(1, 7), (2, None), (3, None), (4, None), (5, None), (6, None)]


def test_long_chains_settle(spark):
    n = 3000
    nodes = spark.range(n + 1).withColumnRenamed("id", "node")
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.connected_components(nodes, edges).filter("component = 0").count() == n + 1


def test_the_last_case_of_a_text_counts(spark):
    cases = spark.createDataFrame([(1, "text ", "9"), (3, " text", "7"), (2, "text", "4")], "test_no int, ground_truth string, extracted_true_value string")
    answers = spark.createDataFrame([(1, "text"), (2, "other"), (3, None)], "id int, reference string")
    got = scoring.with_true_value(answers, cases).select("id", "true_value").collect()
    assert sorted(map(tuple, got)) == [(1, 7.0), (2, None), (3, None)]


def test_a_month_reaches_the_scan(spark, tmp_path):
    from fairlead.plans import bindings

    spark.createDataFrame([(1, 1, dt.date(1997, 1, 31)), (2, 1, dt.date(1997, 2, 1)), (3, 1, dt.date(1996, 12, 31))],
                          "o_orderkey long, o_custkey long, o_orderdate date").selectExpr(
        "*", "'1-URGENT' o_orderpriority", "'O' o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L c_custkey, 'S' c_mktsegment, 3 c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("""SELECT id AS l_orderkey, 1 l_linenumber, 'A' l_returnflag, 'O' l_linestatus, 2.0D l_quantity, 3L l_suppkey, 4L l_partkey,
        5.0D l_extendedprice, timestamp_ntz'1997-01-01 00:00:00' l_shipdate FROM range(1, 4)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    trips = bindings.trips(spark, str(tmp_path), 1997, 1)
    assert [r.trip_id for r in trips.collect()] == [1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = bindings.trips(spark, str(tmp_path), 1997, 1)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in plan and "LessThan(o_orderdate,1997-02-01" in plan


def test_appending_twice_changes_nothing(spark, tmp_path):
    from fairlead.sources import store

    rows = spark.createDataFrame([(1, None, 2.0, 3.0, 5.0), (2, None, 1.0, 1.0, 2.0)],
                                 "id long, query_result_id long, prompt_tokens double, completion_tokens double, total_tokens double")
    for _ in range(2):
        store.append({"token_usage": rows}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/token_usage").count() == 2


def test_a_killed_append_leaves_whole_rows_once(spark, tmp_path, monkeypatch):
    """Killed between tables, a job shows nothing; run again it shows all rows once, beside other batches."""
    from fairlead.sources import store

    usage = lambda *ids: spark.createDataFrame([(i, "r", 1.0, 2.0, 3.0) for i in ids],
                                               "id string, query_result_id string, prompt_tokens double, completion_tokens double, total_tokens double")
    models = spark.createDataFrame([(3, "m", "open source")], "id int, name string, type string")
    folder, publish = str(tmp_path), store._publish
    count = lambda: {n: df.count() for n, df in store.read_store(spark, folder).items() if n in ("llm_models", "token_usage")}

    def killed(*_):
        raise RuntimeError("killed")
    monkeypatch.setattr(store, "_publish", killed)
    with pytest.raises(RuntimeError):
        store.append({"llm_models": models, "token_usage": usage("a", "b")}, folder, "job 1")
    assert count() == {"llm_models": 0, "token_usage": 0}
    monkeypatch.setattr(store, "_publish", publish)
    for _ in range(2):
        store.append({"llm_models": models, "token_usage": usage("a", "b", "b")}, folder, "job 1")
    assert count() == {"llm_models": 1, "token_usage": 2}
    first = store.append({"token_usage": usage("c")}, folder)
    assert first == store.append({"token_usage": usage("c")}, folder) != store.append({"token_usage": usage("d")}, folder)
    assert count() == {"llm_models": 1, "token_usage": 4}
    publish(spark, f"{folder}/_commits/{first}.json", "another writer's")  # the first commit stands
    assert count() == {"llm_models": 1, "token_usage": 4}
    assert store.committed(spark, folder).count() == 3
