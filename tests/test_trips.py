"""Null rules, ties and strict thresholds of trip and telemetry jobs."""

import datetime as dt
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fairlead.functions import calendar as cal
from fairlead.functions import measures as m
from fairlead.operators import asof, ranks, scan, telemetry as tm, trips as t, windows
from fairlead.sources import sinks
from fairlead.streaming import stream

T0 = dt.datetime(2024, 1, 5, 8, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def trips(spark):
    hour = dt.timedelta(hours=1)
    rows = [
        # both directions, one direction, none, zero duration, no vehicles
        ("R", "Alpha", T0, 10.0, 20.0, 4.0, 6.0, T0, T0 + hour, T0, T0 + 2 * hour, 2, 2),
        ("R", "Alpha", T0 + dt.timedelta(days=1), 30.0, None, 3.0, None, T0, T0, None, None, 5, None),
        ("R", "Beta", T0 + dt.timedelta(days=2), None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, """route_name string, ferry_name string, time_departure timestamp_ntz,
        fuelcons_outbound_l double, fuelcons_inbound_l double, distance_outbound_nm double, distance_inbound_nm double,
        start_time_outbound timestamp_ntz, end_time_outbound timestamp_ntz, start_time_inbound timestamp_ntz,
        end_time_inbound timestamp_ntz, pedestrians_outbound int, pedestrians_inbound int""")


def test_null_rules(trips):
    rows = {r.ferry_name: r for r in t.fuel_cost(trips, price=2.0).collect()}
    assert rows["Alpha"].total_cost == 120.0 and rows["Beta"].total_cost == 0.0
    assert t.mean_distance(trips).first().avg_distance_nm == 5.0
    assert t.mean_fuel(trips).first().n_trips == 1
    assert t.fuel_efficiency(trips).first().l_per_nm == 3.0


def test_speed_is_a_mean_over_single_crossings(trips):
    rows = {r.ferry_name: r for r in t.average_speed(trips, unit="kn").collect()}
    # 4 nm in 1 h and 6 nm in 2 h; the crossing without duration counts nowhere.
    assert rows["Alpha"].avg_speed_kn == pytest.approx(3.5) and rows["Alpha"].n_crossings == 2
    assert rows["Beta"].avg_speed_kn is None


def test_ratio_rules(spark):
    row = spark.range(1).select(
        m.ratio(F.lit(1.0), F.lit(0.0)).alias("a"), m.ratio(F.lit(1.0), F.lit(0.0), "inf").alias("b"),
        m.ratio(F.lit(None).cast("double"), F.lit(2.0), "inf").alias("c")).first()
    assert row.a is None and row.b == float("inf") and row.c is None


def test_pce_weights(spark):
    df = spark.createDataFrame([(22, 2, 0, 27.0, 0, 0, 1, 9.0)], """cars_outbound int, trucks_outbound int, buses_outbound int,
        passenger_car_equivalent_outbound double, cars_inbound int, trucks_inbound int, buses_inbound int,
        passenger_car_equivalent_inbound double""")
    row = m.with_pce(df).first()
    assert row.pce_outbound == 27.0 and row.pce_inbound == 9.0 and m.pce_mismatch(df).count() == 0


def test_calendar_filter_prunes_by_range(trips):
    kept = cal.calendar_filter(trips, "time_departure", month=1, year=2024)
    assert kept.count() == 3 and cal.calendar_filter(trips, "time_departure", month=12, year=2023).count() == 0
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "2024-02-01" in plan


def test_capacity_ignores_case_and_unknown_names(spark, trips):
    fleet = spark.createDataFrame([("alpha", 40.0)], "name string, capacity_passenger_car_equivalent double")
    rows = {r.ferry_name: r.capacity for r in t.with_capacity(trips, fleet).select("ferry_name", "capacity").collect()}
    assert rows == {"Alpha": 40.0, "Beta": None}


def points(spark, seconds, vessel="v", step=0.001, sog=5.0):
    rows = [(vessel, at(s), 59.0 + step * i, 18.0, sog, 36.0) for i, s in enumerate(seconds)]
    return spark.createDataFrame(
        rows, "vessel_id string, time timestamp_ntz, lat double, lon double, sog double, engine_fuelcons_lph double")


def test_gap_of_sixty_seconds_stays_in_the_trip(spark):
    rows = tm.trip_points(points(spark, [0, 60, 120.001, 125, 400]), ["vessel_id"])
    table = tm.trip_table(rows, ["vessel_id"], ["engine_fuelcons_lph"]).orderBy("trip_no").collect()
    # The last point is a trip of its own and drops out.
    assert [r.n_points for r in table] == [2, 2]
    assert table[0].fuel_l == pytest.approx(2 * 36 * 5 / 3600)
    assert table[0].distance_nm == pytest.approx(111.19493 / 1852, rel=1e-5)
    assert table[0].start_time == dt.datetime(2024, 1, 5, 9, 0, 0)


def test_slow_points_go_before_gaps_are_measured(spark):
    rows = points(spark, [0, 50, 100]).withColumn("sog", F.when(F.col("lat") == 59.001, 0.99).otherwise(1.0))
    assert [r.trip_no for r in tm.trip_points(rows, ["vessel_id"]).orderBy("time").collect()] == [0, 1]


@pytest.mark.parametrize("task_rows", [0, 3, 500_000])
def test_segmentation_ignores_range_edges(spark, task_rows, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", task_rows)
    seconds = [0, 30, 59, 3590, 3610, 3625, 7300]
    found = windows.segment(points(spark, seconds), ["vessel_id"], "time", 60).orderBy("time").collect()
    assert [r.trip_no for r in found] == [0, 0, 0, 1, 1, 1, 2]


def test_missing_fuel_sample_voids_the_sum(spark):
    rows = points(spark, [0, 5, 10]).withColumn(
        "engine_fuelcons_lph", F.when(F.col("lat") != 59.001, F.col("engine_fuelcons_lph")))
    table = tm.trip_table(tm.trip_points(rows, ["vessel_id"]), ["vessel_id"], ["engine_fuelcons_lph"])
    assert table.first().fuel_l is None


def test_nearest_join_edges(spark):
    left = spark.createDataFrame([(1, "k", at(300)), (2, "k", at(901)), (3, "k", at(50)), (4, "z", at(0))],
                                 "id int, by string, t timestamp_ntz")
    right = spark.createDataFrame([(10, "k", at(0)), (12, "k", at(100)), (11, "k", at(100)), (13, "k", at(600))],
                                  "rid int, by string, rt timestamp_ntz")
    found = asof.asof_nearest(left, right, ["by"], "t", "rt", 300, ["rid"], "rid")
    # 1: 200 s back beats 300 s ahead; 2: 301 s is too far; 3: a tie goes to the earlier; 4: no such key
    assert {r.id: r.rid for r in found.collect()} == {1: 11, 2: None, 3: 10, 4: None}
    exact = asof.asof_nearest(left.filter("id = 2"), right, ["by"], "t", "rt", 301, ["rid"], "rid")
    assert exact.first().rid == 13


def test_last_trip_is_its_own_inbound(spark):
    rows = spark.createDataFrame([("v", 0, at(0), at(60)), ("v", 1, at(100), at(1000))],
                                 "vessel_id string, trip_no int, start_time timestamp_ntz, end_time timestamp_ntz")
    found = {r.trip_no: r.inbound_trip_no for r in asof.pair_inbound(rows, ["vessel_id"]).collect()}
    assert found == {0: 1, 1: 1}
    strict = {r.trip_no: r.inbound_trip_no for r in asof.pair_inbound(rows, ["vessel_id"], max_minutes=10, self_if_last=False).collect()}
    assert strict == {0: 1, 1: None}


def test_timetable_sees_midnight(spark):
    trips = spark.createDataFrame([(1, "R", dt.datetime(2024, 1, 1, 23, 57)), (2, "R", dt.datetime(2024, 1, 1, 12, 6))],
                                  "id int, route string, t timestamp_ntz")
    slots = spark.createDataFrame([("R", 0.0), ("R", 43_200.0)], "route string, slot double")
    found = {r.id: (r.slot, r.doubtful) for r in asof.match_timetable(trips, slots, "route", "t", "slot").collect()}
    assert found == {1: (0.0, False), 2: (None, True)}


def test_telemetry_select_bounds(spark):
    rows = spark.createDataFrame([("v", at(0), "Main_SOG", 1.0), ("v", at(60), "sog", 2.0), ("w", at(0), "sog", 3.0)],
                                 "vessel_id string, time timestamp_ntz, parameter_id string, value double")
    found = tm.telemetry_select(rows, "v", "2024-01-05T08:00:00", "2024-01-05T08:01:00", ["sog"])
    assert [r.value for r in found.collect()] == [1.0]
    for bad in (("2024-01-05", "2024-01-05", None), ("2023-04-30T21:59:59", "2024-01-01", None), ("2024-01-01", "2024-01-02", "7 seconds")):
        with pytest.raises(ValueError):
            tm.telemetry_select(rows, "v", bad[0], bad[1], ["sog"], bad[2])


def test_bucket_average_keeps_mean_time(spark):
    rows = spark.createDataFrame([("v", at(0), "p", 1.0), ("v", at(3), "p", 3.0), ("v", at(5), "p", 9.0)],
                                 "vessel_id string, time timestamp_ntz, parameter_id string, value double")
    found = stream.bucket_average(rows, "5 seconds").orderBy("bucket").collect()
    assert [(r.bucket, r.avg_time, r.avg_value) for r in found] == [(at(0), at(1.5), 2.0), (at(5), at(5), 9.0)]


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    values = np.random.default_rng(1).integers(0, 50, 401) / 49
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)], "g string, v double")
    found = {r.g: r for r in ranks.quantiles(rows, ["g"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    assert found["a"].q1 == pytest.approx(np.quantile(values, 0.25)) and found["a"].q2 == pytest.approx(np.median(values))
    assert found["b"].q1 == 1.0


def test_enrichment_fills_both_directions(spark):
    seconds = [0, 5, 10, 200, 205, 400]
    long = points(spark, seconds).select("vessel_id", "time", F.inline(F.array(*[
        F.struct(F.lit(n).alias("parameter_id"), F.col(c).alias("value")) for n, c in (
            (tm.LAT, "lat"), (tm.LON, "lon"), (tm.SOG, "sog"), ("engine_fuelcons_lph", "engine_fuelcons_lph"))])))
    # Departures are local: CET is an hour ahead.
    hour = dt.timedelta(hours=1)
    trips = spark.createDataFrame([(1, "Alpha", T0 + hour), (2, "ALPHA", T0 + hour + dt.timedelta(minutes=20)), (3, "Other", T0)],
                                  "id int, ferry_name string, time_departure timestamp_ntz")
    fleet = spark.createDataFrame([("alpha", "v")], "name string, vessel_id string")
    found = {r.id: r for r in tm.enrich_trips(trips, fleet, long, fuel=["engine_fuelcons_lph"]).collect()}
    assert found[1].start_time_outbound == T0 + hour and found[1].start_time_inbound == at(200) + hour
    assert found[1].fuelcons_outbound_l == pytest.approx(3 * 36 * 5 / 3600)
    assert found[2].start_time_outbound is None and found[3].distance_inbound_nm is None


@pytest.mark.parametrize("unit", [1e-9, 1.0, 1e9])
@pytest.mark.parametrize("task_rows", [5, 500_000])
def test_quantiles_of_any_unit(spark, unit, task_rows, monkeypatch):
    """Neither the unit of the values nor a key with most of them matters."""
    monkeypatch.setattr(scan, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(6)
    values = {"hot": rng.gamma(0.3, 5, 300), "a": rng.integers(0, 4, 40).astype(float), "one": np.array([7.0])}
    df = spark.createDataFrame([(g, float(v) * unit) for g, vs in values.items() for v in vs], "g string, v double").repartition(4)
    found = {r.g: r for r in ranks.quantiles(df, ["g"], "v", {"q1": 0.25, "median": 0.5, "q9": 0.9}).collect()}
    box = {r.g: r for r in ranks.boxplot(df, ["g"], "v").collect()}
    for g, vs in values.items():
        want = np.quantile(vs * unit, [0.25, 0.5, 0.9, 0.75])
        assert [found[g].q1, found[g].median, found[g].q9, box[g].q3] == pytest.approx(list(want), rel=1e-9) and found[g].n == len(vs)


def test_layout_reads_few_row_groups(spark, tmp_path):
    """One vessel and a few days: other days' folders and other vessels' row groups are not read."""
    rows = spark.range(60_000).select(
        F.concat(F.lit("v"), F.expr("case when id % 3 = 0 then 7 else id % 40 end").cast("string")).alias("vessel_id"),
        F.lit("sog").alias("parameter_id"), F.expr("timestamp_ntz '2024-01-05 00:00:00' + make_dt_interval(0, 0, 0, id * 6)").alias("time"),
        F.sha2(F.col("id").cast("string"), 256).alias("value")).repartition(8)
    rows.write.parquet(f"{tmp_path}/plain")
    sinks.write_telemetry(rows, f"{tmp_path}/laid", vessels=100, group_bytes=20_000)

    def read(folder):
        found = tm.telemetry_select(spark.read.parquet(f"{tmp_path}/{folder}"), "v11", "2024-01-06T00:00:00", "2024-01-07T00:00:00", ["sog"])
        got = sorted(map(tuple, found.select("time", "value").collect()))
        plan = found.select("time", "value")._jdf.queryExecution()
        plan.toRdd().count()
        scan_ = plan.executedPlan().collectLeaves().head()
        return got, scan_.metrics().get("numOutputRows").get().value()

    (plain, all_rows), (laid, few_rows) = read("plain"), read("laid")
    assert plain == laid and len(plain) > 200
    assert all_rows == 60_000 and few_rows < 6_000 and few_rows < 14_400 / 2
    groups = hit = 0
    for path in Path(tmp_path, "laid", "day=2024-01-06").glob("*.parquet"):
        told = pq.ParquetFile(path).metadata
        for g in range(told.num_row_groups):
            column = told.row_group(g).column(0)
            assert column.path_in_schema == "vessel_id"
            groups += 1
            hit += column.statistics.min <= "v11" <= column.statistics.max
    assert groups > 8 and hit <= groups / 3
