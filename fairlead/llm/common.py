"""What the operators of this package share: inputs, written tables, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.session import scratch

# Rows of one number range: a key's rows are numbered in pieces of about this many.
RANGE_ROWS = 50_000
# Rows an Arrow batch holds. Texts may be very long, so batches are kept short.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: short Arrow batches, adaptive joins that split skewed keys."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends here, any executor can be lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """128-bit key of a text as 16 bytes; equal texts, equal keys. A null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")).cast("binary")))


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Add ``name``: a gapless number from 0 for the rows of each key.

    A key's rows are dealt to ranges by a hash of ``order``; each range numbers its own rows and
    starts after the rows of the ranges before it. So a key with most of the rows is numbered by
    many tasks, and only one row per key and range is summed up.
    """
    ranges = max(1, -(-rows // RANGE_ROWS))
    dealt = df.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(ranges)))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_key_range"),
        (F.sum("_rows").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_rows")).alias("_start"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_key_range")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    return own.join(starts, same).select(
        *[F.col(c) for c in df.columns], (F.col("_start") + F.col("_own") - 1).alias(name))
