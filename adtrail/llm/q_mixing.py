"""op7: the mix over all documents. Its draws are pseudorandom, so there is no SQL for it; the
tests hold it against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.mixing import mixture_counts
from adtrail.llm.registry import query


@query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixture_counts(spark.read.parquet(f"{sf}/documents.parquet"))
