"""Scans over ranges against plain loops, with a key that holds most rows, null keys, ties and any splitters."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fairlead.operators import asof, scan, telemetry as tm, warehouse, windows

T = dt.datetime(2023, 6, 1, 8)


@pytest.fixture(params=[0, 40, 500_000])
def task_rows(request, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", request.param)
    return request.param


@pytest.fixture(scope="module")
def data():
    """A vessel with two thirds of all rows, most of them within one hour."""
    rng = random.Random(11)
    rows = [("hot", rng.random() * (3600 if rng.random() < 0.8 else 90_000)) for _ in range(200)]
    rows += [(rng.choice(["a", "b", None]), rng.random() * 90_000) for _ in range(100)]
    return [(i, k, T + dt.timedelta(seconds=round(s, 3)), float(rng.randint(-5, 5))) for i, (k, s) in enumerate(rows)]


def frame(spark, data):
    return spark.createDataFrame(data, "id int, k string, ts timestamp_ntz, v double").repartition(5)


def by_key(data):
    keys = collections.defaultdict(list)
    for row in sorted(data, key=lambda r: (r[2], r[0])):
        keys[row[1]].append(row)
    return keys


def test_neighbours(spark, data, task_rows):
    df = frame(spark, data)
    want = {own[0]: (before and before[0], after and after[0]) for rows in by_key(data).values()
            for before, own, after in zip([None, *rows], rows, [*rows[1:], None])}
    before = windows.with_previous(df, ["k"], "ts", {"id": "before"}, ["id"])
    assert {r.id: r.before for r in before.collect()} == {i: b for i, (b, _) in want.items()}
    after = asof.with_next(df, ["k"], ["ts", "id"], {"id": "after"}, self_if_last=False)
    assert {r.id: r.after for r in after.collect()} == {i: a for i, (_, a) in want.items()}
    own = asof.with_next(df, ["k"], ["ts", "id"], {"id": "after"})
    assert {r.id: r.after for r in own.collect()} == {i: i if a is None else a for i, (_, a) in want.items()}


def test_sums_and_positions(spark, data, task_rows):
    df, want = frame(spark, data), {}
    for rows in by_key(data).values():
        total = 0.0
        for row in rows:
            total += row[3]
            want[row[0]] = total
    assert {r.id: r.s for r in windows.running_sum(df, ["k"], ["ts", "id"], F.col("v"), "s").collect()} == want
    assert {r.id: r.position for r in windows.position(df, "id").collect()} == {r[0]: r[0] + 1 for r in data}


def test_trips(spark, data, task_rows):
    points = frame(spark, data).select("k", "ts", "id", F.lit(59.0).alias("lat"), (F.col("id") / 1000).alias("lon"), F.lit(9.0).alias("sog"))
    got = {r.id: r.trip_no for r in tm.trip_points(points, ["k"], "ts").collect()}
    for rows in by_key(data).values():
        trip, last = 0, rows[0][2]
        for row in rows:
            trip += (row[2] - last).total_seconds() > 60
            last = row[2]
            assert got[row[0]] == trip


def test_nearest(spark, data, task_rows):
    left, right = [r for r in data if r[0] % 3], [r for r in data if r[0] % 3 == 0]
    got = asof.asof_nearest(frame(spark, left), frame(spark, right).select("k", F.col("ts").alias("at"), F.col("id").alias("hit")),
                            ["k"], "ts", "at", 600.0, ["hit"], "hit")
    for r in got.collect():
        near = [(abs((x[2] - r.ts).total_seconds()), x[2], x[0]) for x in right if x[1] == r.k and r.k is not None]
        best = min((n for n in near if n[0] <= 600), default=None)
        assert r.hit == (best and best[2])


def test_folds(spark, data, task_rows):
    rows = [(k, i, None if i % 7 == 0 or k == "b" else v, v) for i, k, _, v in data]
    df = spark.createDataFrame(rows, "k string, i int, s double, z double").repartition(3)
    got = {r.k: (r.s, r.z) for r in warehouse.combine(df, ["k"], "i", ["s", "z"], "pairwise").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        out = []
        for at in (2, 3):
            acc = None
            for r in sorted((r for r in rows if r[0] == k and r[at] is not None), key=lambda r: r[1]):
                acc = r[at] if acc is None else (acc + r[at]) / 2
            out.append(acc)
        want[k] = tuple(out)
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert [x is None for x in got[k]] == [x is None for x in pair]
        assert all(x is None or x == pytest.approx(y) for x, y in zip(got[k], pair))


def test_one_hour_of_one_vessel_spreads(spark, monkeypatch):
    """All rows of one key and hour come to many ranges of like size, and every range is scanned."""
    monkeypatch.setattr(scan, "TASK_ROWS", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit("v").alias("k"), F.expr("timestamp_micros(id * 1000)").alias("ts"), "id")
        seen = []
        step = lambda rows, ranges: seen.append((rows, ranges)) or scan.running(rows, ranges, ["k"], ["ts"], F.lit(1), "n")
        out = scan.by_ranges(df, ["k"], ["ts"], step)
        sizes = [r["count"] for r in seen[0][0].groupBy(scan.RANGE).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
        assert out.filter("n <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing(spark, task_rows):
    none = frame(spark, [])
    assert windows.segment(none, ["k"], "ts", 60).count() == windows.position(none, "id").count() == 0
