"""Functions offered to SQL users and an example of a user-written metric."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fairlead.functions.metrics import bleu, pairwise, rouge_l


@F.pandas_udf(DoubleType())
def _length_score(text: pd.Series) -> pd.Series:
    return (text.fillna("").str.split().str.len() / 100).clip(upper=1.0).astype("float64")


def length_score(response: Column) -> Column:
    """Words over a hundred, at most 1: shows how a pandas UDF becomes a metric."""
    return _length_score(response)


class ExplodePath:
    """Table function: the points of a path with their positions."""

    def eval(self, lat, lon):
        for point_no, (a, b) in enumerate(zip(lat, lon)):
            yield point_no, a, b


def register_functions(spark: SparkSession) -> list[str]:
    """Make the metrics and the path table function callable from SQL text."""
    spark.udf.register("bleu", pairwise(bleu))
    spark.udf.register("rouge_l", pairwise(rouge_l))
    spark.udtf.register("explode_path", F.udtf(ExplodePath, returnType="point_no int, lat double, lon double"))
    return ["bleu", "rouge_l", "explode_path"]
