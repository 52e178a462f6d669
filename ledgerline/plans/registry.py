"""Where queries are registered by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a query under its function's name; without SQL it is held against plain Python in the tests."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: Column | str) -> Column:
    """Money as whole hundredths, so that sums are exact in any order."""
    return F.round(F.col(price) * 100 if isinstance(price, str) else price * 100).cast("long")


def n_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
