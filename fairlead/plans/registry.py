"""Named queries over the driver tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.plans.bindings import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, digits: int = 6):
    """Register a query under its inventory id, with check SQL where SQL can express it."""
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(spark, folder), digits)

        run.__name__ = fn.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return register
