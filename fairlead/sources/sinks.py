"""Writers: trips, failures, archives and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_trips(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """The enriched trip table as CSV with a header, or as parquet."""
    writer = df.write.mode(mode).format(format)
    (writer.option("header", True) if format == "csv" else writer).save(path)


def write_failures(df: DataFrame, path: str, category: str = "category", mode: str = "append") -> None:
    """Failures as JSON, a folder per category and test."""
    df.write.mode(mode).partitionBy(category, "test_no").json(path)


def archive_text(question: Column, response: Column, statements: Column) -> Column:
    """Question, response and numbered statements as one text."""
    numbered = F.array_join(F.transform(
        statements, lambda s, i: F.concat(F.lit("\n--- Query "), (i + 1).cast("string"), F.lit(" ---\n"), s, F.lit("\n"))
    ), "")
    return F.concat(
        F.lit("QUERY:\n"), question, F.lit("\n\nRESPONSE:\n"), response,
        F.when(F.size(statements) > 0, F.concat(F.lit("\n\nSQL QUERIES:\n"), numbered)).otherwise(""),
    )


def render_archive(df: DataFrame, question: str = "query", response: str = "response",
                   statements: str = "sql_queries") -> DataFrame:
    return df.withColumn("value", archive_text(F.col(question), F.col(response), F.col(statements)))


def write_archive(df: DataFrame, path: str, key: str, buckets: int = 64, mode: str = "append") -> None:
    """Archive texts as JSON lines (key, value), dealt to as many folders as there are buckets, whatever the results."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    render_archive(df).select(key, "value", bucket).write.mode(mode).partitionBy("bucket").json(path)


def read_archive(spark: SparkSession, path: str, key_type: str, key: str) -> DataFrame:
    return spark.read.schema(f"{key} {key_type}, value string").json(path).select(key, "value")


def write_telemetry(df: DataFrame, path: str, vessel: str = "vessel_id", time: str = "time", vessels: int = 10_000,
                    group_bytes: int = 32 << 20, mode: str = "append") -> None:
    """Readings laid out for the question "one vessel, from then to then".

    A folder per day prunes the time range. Within a day rows are dealt by ranges of (vessel, time), so a
    vessel's rows lie in a few neighbouring row groups whose bounds leave out all others, and a vessel with most rows
    still spreads; a Bloom filter on the vessel leaves out groups whose bounds merely enclose it. ``vessels`` is
    the number of vessels the filter is sized for.
    """
    laid = df.withColumn("day", F.to_date(time)).repartitionByRange("day", vessel, time).sortWithinPartitions("day", vessel, time)
    laid.write.mode(mode).partitionBy("day").option(f"parquet.bloom.filter.enabled#{vessel}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{vessel}", str(vessels)).option("parquet.block.size", str(group_bytes)).parquet(path)


def to_records(df: DataFrame) -> DataFrame:
    """Each row as a JSON record; averages become floating point, nulls stay visible."""
    cols = [F.col(n).cast("double").alias(n) if n.startswith("avg_") else F.col(n) for n in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))
