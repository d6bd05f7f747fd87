"""op3: main text of all pages. SQL has no such rule; the tests use pages whose article is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.pages import extract_pages
from adtrail.llm.registry import query


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf}/pages.parquet"))
