"""Layout of the evaluation store and the rows an answer adds to it."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.operators.scoring import coerce_scores
from fairlead.operators.warehouse import SCORES


COMMITS = "_commits"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, n != "id") for n, t in fields])


_I, _S, _D = T.IntegerType(), T.StringType(), T.DoubleType()


def eval_schemas() -> dict[str, T.StructType]:
    """Schemas of the five tables and of the attempt log. Table and column names."""
    return {
        "llm_models": _struct(("id", _I), ("name", _S), ("type", _S)),
        "query_result": _struct(
            ("id", _S), ("llm_model_id", _I), ("query", _S), ("direct_response", _S), ("full_response", _S),
            ("sql_queries", _S), ("test_no", _I), ("tool_calls", _S), ("timestamp", T.TimestampNTZType())),
        "query_evaluation": _struct(
            ("id", _S), ("query_result_id", _S), ("evaluation_metrics_id", _S), ("retrieved_contexts", _S),
            ("ground_truth", _S)),
        "evaluation_metrics": _struct(("id", _S), *[(s, _D) for s in SCORES]),
        "token_usage": _struct(
            ("id", _S), ("query_result_id", _S), ("prompt_tokens", _D), ("completion_tokens", _D), ("total_tokens", _D)),
        "run_attempt_history": T.StructType([
            T.StructField(n, t) for n, t in (
                ("model_id", _S), ("test_case_id", _S), ("run_number", _I), ("attempt_status", _S), ("error_message", _S),
                ("query_evaluation_id", _S), ("retry_count", _I), ("attempt_ts", T.TimestampNTZType()))]),
    }


def seed_models(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed models whose name is not there yet."""
    return seed.join(existing.select("name"), "name", "left_anti").select(*seed.columns)


def fan_out(scored: DataFrame, key: str, evaluated: bool = True) -> dict[str, DataFrame]:
    """Split wide answer rows into the rows of the store's tables.

    Ids are 128-bit hashes of the table and ``key``, as hex digits, so a retried job writes the same ids and
    no task waits for a counter. A row with ``existing_query_result_id`` adds no result. Only
    rows with token usage add a token row.
    """
    def row_id(table: str) -> Column:
        return F.md5(F.concat(F.lit(f"{table}/"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))

    existing = F.col("existing_query_result_id").cast("string")
    rows = scored.withColumn("query_result_id", F.coalesce(existing, row_id("query_result")))
    parts = {
        "query_result": rows.filter(F.col("existing_query_result_id").isNull()).select(
            F.col("query_result_id").alias("id"), "llm_model_id", "query", "direct_response", "full_response",
            "sql_queries", "test_no", "tool_calls", "timestamp"),
    }
    if evaluated:
        parts["evaluation_metrics"] = coerce_scores(rows, list(SCORES)).select(
            row_id("evaluation_metrics").alias("id"), *SCORES)
        parts["query_evaluation"] = rows.select(
            row_id("query_evaluation").alias("id"), "query_result_id",
            row_id("evaluation_metrics").alias("evaluation_metrics_id"), "retrieved_contexts", "ground_truth")
    parts["token_usage"] = rows.filter(F.col("token_usage").isNotNull()).select(
        row_id("token_usage").alias("id"), "query_result_id", "token_usage.*")
    return parts


def batch_id(parts: dict[str, DataFrame]) -> str:
    """A name for these rows that depends on their ids alone, so the same rows are the same batch."""
    told = [df.agg(F.concat_ws(".", F.lit(n), F.count(F.lit(1)).cast("string"), F.coalesce(F.bit_xor(
        F.xxhash64(F.col("id").cast("string"))), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(
            F.xxhash64(F.lit(n), F.col("id").cast("string"))), F.lit(0)).cast("string")).alias("part"))
        for n, df in sorted(parts.items())]
    names = [df.first()["part"] for df in told]
    return hashlib.md5("/".join(names).encode()).hexdigest()


def append(parts: dict[str, DataFrame], folder: str, batch: str | None = None, format: str = "parquet") -> str:
    """Add the rows of several tables to the store as one batch, all or nothing; the batch's name is returned.

    Each table's rows are staged in a folder of the batch. Then one small file is renamed into the list of
    commits, which is the only step readers see. A job killed before that leaves nothing that is read, and a
    rerun under the same name writes its stage anew. A committed batch is not written again. Without
    a name the rows' ids give one. The store itself is never read.
    """
    spark = next(iter(parts.values())).sparkSession
    batch = batch or batch_id(parts)
    commit = f"{folder}/{COMMITS}/{batch}.json"
    if not _exists(spark, commit):
        for name, df in parts.items():
            df.dropDuplicates(["id"]).write.mode("overwrite").format(format).save(f"{folder}/{name}/batch={batch}")
        _publish(spark, commit, json.dumps({"batch": batch, "tables": sorted(parts)}))
    return batch


def _place(spark: SparkSession, path: str):
    """A path and its file system, by the session's own settings."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it there; whoever comes second leaves the first one's."""
    place, files = _place(spark, path)
    draft, _ = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(draft, place):
        files.delete(draft, False)
        if not files.exists(place):
            raise OSError(f"could not commit {path}")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, tables) of all commits."""
    schema = "batch string, tables array<string>"
    if not _exists(spark, f"{folder}/{COMMITS}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{folder}/{COMMITS}")


def read_store(spark: SparkSession, folder: str, format: str = "parquet") -> dict[str, DataFrame]:
    """The store's tables, of committed batches alone; the commits are as many as the jobs that ran."""
    schemas = eval_schemas()
    batches = committed(spark, folder).orderBy("batch").collect()
    held = {}
    for n in ("llm_models", "query_result", "query_evaluation", "evaluation_metrics", "token_usage"):
        paths = [f"{folder}/{n}/batch={r['batch']}" for r in batches if n in r["tables"]]
        held[n] = spark.read.schema(schemas[n]).format(format).load(paths) if paths else spark.createDataFrame([], schemas[n])
    return held
