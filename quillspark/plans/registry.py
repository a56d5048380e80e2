"""Registry of queries: one callable (spark, sf_dir) -> DataFrame per operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn

    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column (values are compared to 6 places against the SQL oracle)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
