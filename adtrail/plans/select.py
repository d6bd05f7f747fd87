"""Exact selection by rank without sorting all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BUCKETS = 4096


def nth_smallest(df: DataFrame, column: str, nth: int, buckets: int = BUCKETS) -> int | None:
    """The ``nth`` (from 1) smallest value of an integer column, NULLs left out; NULL if there are
    fewer.

    Each round counts the values of the range still open by equal parts of it, which partial
    aggregation brings down to a row per part and task, and goes on in the part that holds the
    rank. A range of 64 bits takes six rounds at the most, and one value in a part ends the search.
    """
    values = df.select(F.col(column).cast("long").alias("v")).where("v is not null")
    span = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high, n = span
    if nth < 1 or nth > n:
        return None
    while low < high:
        width = -(-(high - low + 1) // buckets)
        part = F.call_function("div", F.col("v").cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)"),
                               F.lit(str(width)).cast("decimal(20,0)"))
        parts = values.where(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect()
        for p in parts:
            if nth <= p.n:
                low, high = p.low, p.high
                break
            nth -= p.n
    return low
