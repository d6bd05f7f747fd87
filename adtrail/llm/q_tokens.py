"""op6: tokens of all documents, counted in flat files. SQL cannot tokenise; the tests hold the
counts against the tokenizer itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adtrail.llm.registry import query
from adtrail.llm.tokens import count_tokens, write_token_files
from adtrail.plans.cut import scratch_path


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = scratch_path(spark)
    write_token_files(docs, path)
    counts = count_tokens(spark, path)
    # the files hold the table's partitions in row order
    place = F.monotonically_increasing_id()
    ids = docs.select("doc_id", place.alias("_at")).select(
        "doc_id", F.shiftright("_at", 33).alias("_file"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("doc_no"))
    number = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long")
    return counts.withColumn("_file", number).join(ids, ["_file", "doc_no"]).select("doc_id", "n_tokens")
