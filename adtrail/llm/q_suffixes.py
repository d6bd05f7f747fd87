"""op5: repeated passages of all documents, by bytes, which SQL has no plain way to cut; the tests
hold it against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.registry import query
from adtrail.llm.suffixes import repeat_digests


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeat_digests(spark.read.parquet(f"{sf}/documents.parquet"))
