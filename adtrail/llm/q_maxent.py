"""op4: language-model scores of all documents. A trained model has no SQL; the tests hold counts
and base scores against a brute-force version and the model against held-out texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.maxent import language_scores
from adtrail.llm.registry import query


@query("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf}/documents.parquet"))
