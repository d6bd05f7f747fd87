"""op9: licences stated by documents or by the licence file of their folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adtrail.llm.licenses import scan_licenses
from adtrail.llm.registry import query

#: The table has no paths: a hundred neighbouring ids of a source and language share a folder, and a
#: document that names a licence on any line is a licence file, by its id of the source, of the source
#: and language, or of the folder.
NAMING = r"(?i)\blicen[sc]e"


def document_paths() -> Column:
    names = F.coalesce(F.col("text").rlike(NAMING), F.lit(False))
    level = F.when(names, F.pmod(F.xxhash64("doc_id"), F.lit(3))).otherwise(2)
    return F.concat_ws(
        "/", "source", F.when(level >= 1, F.col("lang")),
        F.when(level == 2, F.floor(F.col("doc_id") / 100).cast("string")),
        F.when(names, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(
            F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return scan_licenses(docs.select("doc_id", "text", document_paths().alias("path")), keep=("doc_id",))
