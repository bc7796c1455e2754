"""The continuous jobs. Each takes a batch or a streaming DataFrame."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bucket widths of averaged telemetry.
BUCKETS = ("5 seconds", "30 seconds", "1 minute", "5 minutes", "10 minutes")


def bucket_average(df: DataFrame, width: str, watermark: str | None = None, time: str = "time") -> DataFrame:
    """Tumbling averages of time and value per vessel and parameter.

    On a stream, rows later than the watermark are dropped; run the batch form to backfill them.
    """
    if watermark and df.isStreaming:
        df = df.withWatermark(time, watermark)
    kind = dict(df.dtypes)[time]
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    # The mean offset inside the bucket keeps the sum small enough to be exact.
    grouped = df.withColumn("_micros", micros).groupBy(
        "vessel_id", F.window(time, width).alias("w"), "parameter_id"
    ).agg(
        F.avg(F.pmod("_micros", F.lit(86_400_000_000))).alias("_avg"), F.min("_micros").alias("_first"),
        F.avg("value").alias("avg_value"),
    )
    day = F.col("_first") - F.pmod("_first", F.lit(86_400_000_000))
    return grouped.select(
        "vessel_id", F.col("w.start").alias("bucket"),
        F.timestamp_micros((day + F.round("_avg")).cast("long")).cast(kind).alias("avg_time"),
        "parameter_id", "avg_value",
    )


def trip_sessions(df: DataFrame, gap: str = "60 seconds", watermark: str | None = None, by: str = "vessel_id",
                  time: str = "time", speed: str | None = "sog", speed_kn: float = 1.0) -> DataFrame:
    """Sessions of moving samples: a pause strictly longer than the gap ends one.

    Single-point sessions drop out, as in the batch segmentation.
    """
    if watermark and df.isStreaming:
        df = df.withWatermark(time, watermark)
    if speed:
        df = df.filter(F.col(speed) >= speed_kn)
    sessions = df.groupBy(by, F.session_window(time, gap).alias("w")).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(F.lit(1)).alias("n_points")
    )
    return sessions.filter(F.col("n_points") > 1).select(by, "start_time", "end_time", "n_points")


def performance_stream(scores: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """Means and deviations per model, kept up to date as scores arrive (complete mode)."""
    return scores.groupBy(model).agg(
        *[F.avg(x).alias(f"avg_{x}") for x in metrics], *[F.stddev_samp(x).alias(f"stddev_{x}") for x in metrics],
        F.count(F.lit(1)).alias("query_evaluation_count"),
    )


def refresh_summary(folder: str):
    """A ``foreachBatch`` writer of summary snapshots; an empty batch leaves the last one.

    Two folders take turns, so the last snapshot stays readable while the next is written and older
    ones are gone. A repeated batch overwrites itself.
    """
    def write(batch_df: DataFrame, batch_id: int) -> None:
        if batch_df.isEmpty():
            return
        named = batch_df.withColumn("snapshot", F.lit(batch_id).cast("long"))
        named.write.mode("overwrite").parquet(f"{folder}/turn={batch_id % 2}")
    return write


def latest_summary(spark, folder: str) -> DataFrame:
    """The newest snapshot."""
    rows = spark.read.parquet(folder)
    newest = rows.agg(F.max("snapshot").alias("snapshot"))
    return rows.join(F.broadcast(newest), "snapshot", "left_semi").drop("snapshot", "turn")


STATEMENT = "session_id long, statement_no long, sql string"
STATE = "statement_no long, current string"


def live_sql(lines: DataFrame, idle: str | None = None) -> DataFrame:
    """Statements of agent logs as they close.

    Rows hold (session_id, line_no, line) and arrive in order between batches. With ``idle``
    a session's open statement follows once the session has been quiet that long; such a
    query polls its timers, so it suits a running trigger, not one that stops when the
    source is drained.
    """
    wait = int(_seconds(idle) * 1000) if idle else None

    def follow(key, frames, state):
        import pandas as pd

        number, current = state.get if state.exists else (0, "")
        closed = []
        if state.hasTimedOut:
            if current:
                closed.append((key[0], number, current.strip()))
            state.update((number, ""))
        else:
            rows = pd.concat(list(frames)).sort_values("line_no")
            for line in rows["line"].fillna(""):
                _, mark, rest = line.partition("Running:")
                text = line.strip()
                if mark:
                    if current:
                        closed.append((key[0], number, current.strip()))
                    number, current = number + 1, rest.strip()
                elif current and text and not text.startswith("INFO"):
                    current = f"{current} {text}"
            state.update((number, current))
            if wait is not None:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame(closed, columns=["session_id", "statement_no", "sql"])

    return lines.groupBy("session_id").applyInPandasWithState(
        follow, STATEMENT, STATE, "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


@contextmanager
def rocksdb_states(spark):
    """Streams started inside keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _seconds(text: str) -> float:
    number, unit = text.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def run_available(df: DataFrame, folder: str, mode: str = "append", format: str = "parquet", each=None) -> None:
    """Process what a source holds now and stop; the checkpoint in ``folder`` resumes later runs.

    States of several kinds and timers (``live``) need the session's RocksDB state store (``rocksdb_states``).
    """
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        query = writer.format(format).start(f"{folder}/data")
    query.awaitTermination()
