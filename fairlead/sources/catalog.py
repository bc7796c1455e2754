"""Named tables: registration through a semantic model, SQL text and frame verbs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that a chosen source file answers to.
SOURCE_NAMES = ("data", "main_data", "ferry_data")
FORMATS = {"csv": {"header": "true"}, "json": {"multiLine": "true"}, "parquet": {}, "orc": {}}


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read by extension. Without a schema a CSV file is scanned once for its types."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"cannot read {path!r}: the extension must be one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**FORMATS[kind])
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", "true")
    return reader.load(path)


def view_name(name: str) -> str:
    """Dashes are no part of a view's name."""
    return name.replace("-", "_")


def model_path(model: dict | None, table: str) -> str | None:
    """Path of a model table; ``-`` and ``_`` are alike, and ``x_info`` finds ``x-info``."""
    wanted = view_name(table)
    for entry in (model or {}).get("tables", []):
        if view_name(entry["name"]) == wanted:
            return entry["path"]
    return None


def register(spark: SparkSession, model: dict | None = None, name: str | None = None, path: str | None = None,
             replace: bool = False, source_file: str | None = None, data_dir: str = ".", schema=None) -> str:
    """Bind a view to a file and return the view's name.

    The source file wins for its fixed names, then the model, then the given path. An
    existing view stays unless ``replace`` is set.
    """
    if source_file and name in SOURCE_NAMES:
        path, name = source_file, name if name == "ferry_data" else "data"
    elif name:
        path = model_path(model, name) or path
    if path is None:
        raise ValueError(f"no path is known for table {name!r}")
    path = path.removeprefix("data/")
    view = view_name(name or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0])
    if not replace and spark.catalog.tableExists(view):
        return view
    full = path if "://" in path or path.startswith("/") else f"{data_dir.rstrip('/')}/{path}"
    try:
        df = load(spark, full, schema)
    except (AnalysisException, ValueError):
        if full.endswith(".json"):
            raise
        df = load(spark, f"{full}.json", schema)
    df.createOrReplaceTempView(view)
    return view


def alias_all(df: DataFrame, model: dict) -> list[str]:
    """Bind one frame to every name of the model."""
    names = [view_name(t["name"]) for t in model["tables"]]
    for name in names:
        df.createOrReplaceTempView(name)
    return names


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def show_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES")


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE `{view_name(name)}`")


# The verbs a named operation may use, each with the parameters it takes.
OPERATIONS = {
    "select": lambda df, columns: df.select(*columns),
    "filter": lambda df, condition: df.filter(condition),
    "head": lambda df, n=5: df.limit(n),
    "sort": lambda df, by, ascending=True: df.orderBy(*by, ascending=ascending),
    "distinct": lambda df: df.distinct(),
    "drop_missing": lambda df, columns=None: df.dropna(subset=columns),
    "fill_missing": lambda df, value: df.fillna(value),
    "rename": lambda df, columns: df.withColumnsRenamed(columns),
    "count": lambda df: df.agg(F.count(F.lit(1)).alias("count")),
    "group": lambda df, by, aggregates: df.groupBy(*by).agg(
        *[F.expr(f"{fn}(`{col}`)").alias(f"{fn}_{col}") for col, fn in aggregates.items() if fn in AGGREGATES]),
    "describe": lambda df, columns=(): df.describe(*columns),
}
AGGREGATES = ("sum", "avg", "min", "max", "count", "stddev", "median")


def apply_op(df: DataFrame, op: str, params: dict | None = None) -> DataFrame:
    """Run an allowed operation; nothing is evaluated as code."""
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op!r}; choose one of {', '.join(OPERATIONS)}")
    bad = set((params or {}).get("aggregates", {}).values()) - set(AGGREGATES)
    if bad:
        raise ValueError(f"unknown aggregates: {sorted(bad)}")
    return OPERATIONS[op](df, **(params or {}))
