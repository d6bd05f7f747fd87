"""op12: spelling variants among the words of all documents. The contract's checksum is not in SQL; the
tests hold the operator against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.registry import query
from adtrail.llm.spellings import variant_groups, word_counts


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variant_groups(word_counts(spark.read.parquet(f"{sf}/documents.parquet")))
