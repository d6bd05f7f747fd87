"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def settle(spark: SparkSession) -> None:
    """Unions as plain unions: in Spark 4.1 a union that keeps its inputs' partitioning can fail
    when adaptive execution coalesces those inputs differently."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            settle(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return register
