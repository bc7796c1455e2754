"""Session settings and the two run-time helpers every job shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def get_session(app: str = "fairlead", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution and the RocksDB state store."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one only for local sessions."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fairlead-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a table in the shared folder.

    For rounds that build on each other: a checkpoint keeps the constraints of its plan, which joins
    multiply from round to round; a table keeps none.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Few rows at a time to Python: answers may be very long, and a batch is held there as text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def compiled_methods(df: DataFrame) -> DataFrame:
    """Leave long expressions to Spark's split projections.

    The JVM never compiles a method of more than 8000 bytes of code, and a whole stage of formulas in one method
    then runs many times slower, row by row.
    """
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return df


def spread(scan: DataFrame) -> DataFrame:
    """Use every core for work that is heavy per row, when a table has too few splits.

    Takes a bare scan, whose splits are known without running anything. Tables with enough
    splits pass unchanged, so large ones are never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def join_lookup(df: DataFrame, lookup: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a lookup table.

    Adaptive execution knows the lookup's bytes once it is computed and broadcasts it only below the
    session's threshold; else the join shuffles and skewed keys are split. Nothing runs before.
    """
    return df.join(lookup, on, how)
