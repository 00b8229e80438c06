"""The library's queries, and the same in SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, tables) as a query; tables(name) reads a table of sf_dir."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add
