"""op10: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtrail.llm.quality import RULES, STOP_WORDS, STOP_WORD_LANGUAGES, quality_scores
from adtrail.llm.registry import query

# the list of stop words binds only texts in its languages
_VERDICT = " and ".join(f"({r.measure} {r.op} {r.bound}{' or unlisted' if r.measure == 'stop_word_ratio' else ''})"
                        for r in RULES)

SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
         lower(regexp_extract(coalesce(lang, ''), '^\s*([A-Za-z]+)', 1)) as said,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
windows as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (
  select doc_id, i from windows
  qualify count(*) over (partition by doc_id, g) > 1),
covered as (
  select doc_id, count(distinct j) as n from (
    select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by 1),
m as (
  select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         said not in ('', 'und', {", ".join(f"'{x}'" for x in STOP_WORD_LANGUAGES)})
           or 2 * length(regexp_replace(t, '[^\p{{Latin}}]', '', 'g')) < length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))
           as unlisted,
         len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) as n_stop,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
         coalesce(c.n, 0) as n_repeat_words
  from d left join covered c on c.doc_id = d.doc_id),
r as (
  select *, len(l) - len(list_distinct(l)) as n_dup_lines,
         n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         case when n_words > 0 then word_chars / n_words else 0.0 end as mean_word_chars,
         case when n_words > 0 then n_symbols / n_words else 0.0 end as symbol_ratio,
         case when n_words > 0 then n_stop / n_words else 0.0 end as stop_word_ratio,
         case when len(l) > 0 then (len(l) - len(list_distinct(l))) / len(l) else 0.0 end
           as dup_line_ratio
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {_VERDICT} as kept
from r
"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
