"""op2: near-duplicate groups of all documents. SQL would have to compare all pairs; the tests
hold it against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.minhash import near_duplicates
from adtrail.llm.registry import query


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
