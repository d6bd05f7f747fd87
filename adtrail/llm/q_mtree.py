"""op8: the five best vectors for every 50th one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.mtree import top_inner_products
from adtrail.llm.registry import query

SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank,
       vec_id, score
from s
qualify rank <= 5
"""


@query("op8_exact_top_k", SQL)
def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf}/embeddings.parquet"))
