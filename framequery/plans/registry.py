"""Queries under their names, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.lower import quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a function of (spark, folder) under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Floating sums depend on the order of their terms in the last digits; comparisons round them."""
    return df.withColumns({c: F.round(quoted(c), n) + F.lit(0.0) for c, n in places.items()})


