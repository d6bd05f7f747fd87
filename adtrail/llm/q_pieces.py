"""op1: SentencePiece ids of all documents. SQL has no such rule; the tests hold it against the
model's own library and an exact round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.pieces import encode_documents
from adtrail.llm.registry import query


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf}/documents.parquet"))
