"""Streams against their batch twins, over several micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fairlead.operators import windows
from fairlead.streaming import live, stream

T0 = dt.datetime(2024, 1, 5, 8, 0, 0)


def source(spark, folder, df, parts, order):
    """Write the rows in order as several files and read them one per batch."""
    for i in range(parts):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def samples(spark):
    seconds = [0, 3, 5, 65, 130, 190.001, 200, 7200, 7300]
    rows = [("v", T0 + dt.timedelta(seconds=s), "p", float(i), 5.0, i // 3) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "vessel_id string, time timestamp, parameter_id string, value double, sog double, part int")


def test_bucket_stream_equals_batch(spark, tmp_path):
    df = samples(spark)
    found = stream.bucket_average(source(spark, tmp_path, df, 3, "time"), "30 seconds", "10 minutes")
    stream.run_available(found, str(tmp_path))
    got = {(r.bucket, r.avg_time): r.avg_value for r in spark.read.parquet(str(tmp_path / "data")).collect()}
    # The newest buckets wait for the watermark.
    limit = T0 + dt.timedelta(seconds=7300 - 600)
    want = {(r.bucket, r.avg_time): r.avg_value for r in stream.bucket_average(df, "30 seconds").collect()
            if r.bucket + dt.timedelta(seconds=30) <= limit}
    assert got == want and len(got) >= 4


def test_session_stream_equals_batch_and_segments(spark, tmp_path):
    df = samples(spark)
    stream.run_available(stream.trip_sessions(source(spark, tmp_path, df, 3, "time"), "60 seconds", "10 minutes"), str(tmp_path))
    got = sorted((r.start_time, r.n_points) for r in spark.read.parquet(str(tmp_path / "data")).collect())
    batch = sorted((r.start_time, r.n_points) for r in stream.trip_sessions(df, "60 seconds").collect())
    segments = windows.segment(df, ["vessel_id"], "time", 60).groupBy("trip_no").agg(
        F.min("time").alias("s"), F.count("*").alias("n")).filter("n > 1")
    assert got == batch == sorted((r.s, r.n) for r in segments.collect())
    assert [n for _, n in got] == [4, 2]


def test_statements_across_batches(spark, tmp_path):
    lines = ["Running: SELECT 1", "FROM a", "INFO x", "FROM b", "Running: SELECT 2", "FROM c", "Running: SELECT 3"]
    df = spark.createDataFrame([(1, i, x, i // 3) for i, x in enumerate(lines)], "session_id long, line_no int, line string, part int")
    stream.run_available(stream.live_sql(source(spark, tmp_path, df, 3, "line_no")), str(tmp_path))
    got = [r.sql for r in spark.read.parquet(str(tmp_path / "data")).orderBy("statement_no").collect()]
    assert got == ["SELECT 1 FROM a FROM b", "SELECT 2 FROM c"]


def test_summary_snapshots(spark, tmp_path):
    df = samples(spark)
    live = stream.performance_stream(source(spark, tmp_path, df, 3, "time"), "vessel_id", ["value"])
    stream.run_available(live, str(tmp_path), "complete", each=stream.refresh_summary(str(tmp_path / "out")))
    row = stream.latest_summary(spark, str(tmp_path / "out")).first()
    assert row.query_evaluation_count == 9 and row.avg_value == 4.0


@pytest.fixture
def states(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    with stream.rocksdb_states(spark):
        yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_trips(rows, gap):
    """(vessel, start, end, points, hours times speed) of trips of two points or more, by one loop."""
    out = []
    for vessel in sorted({r[0] for r in rows}):
        trip = []
        for time, speed in [*sorted((r[1], r[2]) for r in rows if r[0] == vessel), (None, None)]:
            if trip and (time is None or (time - trip[-1][0]).total_seconds() > gap):
                if len(trip) > 1:
                    area = sum((a[1] + b[1]) / 2 * (b[0] - a[0]).total_seconds() / 3600 for a, b in zip(trip, trip[1:]))
                    out.append((vessel, trip[0][0], trip[-1][0], len(trip), round(area, 6)))
                trip = []
            trip.append((time, speed))
    return out


def test_live_trips_equal_plain_ones(spark, tmp_path, states):
    rng = random.Random(3)
    rows, clock = [], {v: T0 for v in "ab"}
    for i in range(240):
        v = rng.choice("ab")
        clock[v] += dt.timedelta(seconds=rng.choice([1, 30, 60, 60.001, 200]))
        rows.append((v, clock[v], rng.choice([1.0, 2.5, 7.0])))
    order = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.random() * 100)).timestamp())
    last = max(r[1] for r in rows) + dt.timedelta(days=1)
    parts = [(*r, i // 60) for i, r in enumerate(order)] + [("clock", last, 0.0, 4)]
    df = spark.createDataFrame(parts, "vessel_id string, time timestamp, sog double, part int")
    df = df.unionByName(spark.createDataFrame([("a", None, 1.0, 0)], df.schema))
    stream.run_available(live.live_trips(source(spark, tmp_path, df, 5, "time"), "60 seconds", "10 minutes", "5 minutes"), str(tmp_path))
    got = sorted((r.vessel_id, r.start_time, r.end_time, r.n_points, round(r.total_sog, 6))
                 for r in spark.read.parquet(str(tmp_path / "data")).collect())
    want = plain_trips(rows, 60)
    assert got == want and len(want) > 10
    # Many of them cross an edge of ranges.
    assert sum(s.minute // 5 != e.minute // 5 for _, s, e, _, _ in want) > 3


def test_running_trips_and_late_samples(spark, tmp_path, states):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("v", at(0), 6.0, 0), ("v", at(60), 6.0, 0), ("v", at(30), 12.0, 1), ("v", at(7200), 1.0, 2), ("w", at(7200), 1.0, 3), ("v", at(90), 6.0, 4)],
                               "vessel_id string, time timestamp, sog double, part int")
    seen = []
    found = live.running_trips(source(spark, tmp_path, df, 5, "time"), "60 seconds", "1 minute", "10 minutes")
    stream.run_available(found, str(tmp_path), "update", each=lambda rows, _: seen.extend((r.n_points, round(r.total_sog, 6)) for r in rows.collect()))
    # The first range grows with each batch; a sample that comes after the batch that closed it is late.
    assert seen == [(2, 0.1), (3, 0.15), (1, 0.0), (1, 0.0)]


def test_live_statements_close_in_the_stream(spark, tmp_path, states):
    lines = ["Running: SELECT 1", "FROM a", "INFO x", "FROM b", "Running: SELECT 2", "FROM c", "Running:", "lost", "Running: SELECT 3"]
    rows = [(1, i, T0 + dt.timedelta(seconds=i), x, i // 3) for i, x in enumerate(lines)]
    rows += [(2, 0, T0, "no statement", 0), (2, 1, T0, "Running: SELECT 9", 1), (2, 2, T0, None, 1), (None, 0, T0, "Running: SELECT 0", 1),
             (None, 0, T0 + dt.timedelta(hours=1), "", 3)]
    df = spark.createDataFrame(rows, "session_id long, line_no int, time timestamp, line string, part int")
    stream.run_available(live.live_statements(source(spark, tmp_path, df, 4, "line_no"), "1 minute", "30 seconds"), str(tmp_path))
    got = sorted((r.session_id, r.statement_no, r.sql) for r in spark.read.parquet(str(tmp_path / "data")).collect())
    assert got == [(1, 1, "SELECT 1 FROM a FROM b"), (1, 2, "SELECT 2 FROM c"), (1, 4, "SELECT 3"), (2, 1, "SELECT 9")]
