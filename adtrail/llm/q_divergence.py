"""op13: how the sources of each language differ, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.bindings.registry import settle
from adtrail.llm.divergence import source_divergence
from adtrail.llm.registry import query

SQL = r"""
with d as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
w as (
  select d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from w group by all),
k as (
  select lang, term, count(distinct d) as docs, count(*) as n from w group by all having count(distinct d) >= 30),
v as (select lang, count(*) as v, sum(n) as n from k group by 1),
g as (select distinct lang, source from d),
s as (
  select g.lang, g.source, sum(coalesce(c.n, 0)) as n
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
  group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + 1000000000 * (coalesce(c.n, 0) + 5) // (s.n + 5 * v.v) as p,
         1 + 1000000000 * (k.n + 5) // (v.n + 5 * v.v) as q
  from g join k using (lang) join v using (lang) join s on s.lang = g.lang and s.source = g.source
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
u as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, value::bigint as value,
       (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from u
qualify part = 'pair' or rank <= 50
"""


@query("op13_source_divergence", SQL)
def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    settle(spark)
    return source_divergence(spark.read.parquet(f"{sf}/documents.parquet"))
