"""Quality rules: a threshold table compiled into one Spark projection (DataFrame functions only).

Every measure is taken over the whole text, inside the row: nothing is shuffled.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from adtrail.llm.text import words

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "for", "this",
    "der", "die", "das", "und", "ist", "den", "mit", "von", "zu", "ein", "nicht", "sich",
    "le", "la", "les", "des", "et", "un", "une", "que", "qui", "dans", "est", "pour",
    "el", "los", "las", "de", "en", "y", "por", "una", "con", "para", "se", "del",
)

#: Languages that the list covers, as they stand in a column of languages.
STOP_WORD_LANGUAGES = ("en", "de", "fr", "es")

_OPS = {">=": operator.ge, "<=": operator.le}


@dataclass(frozen=True)
class Rule:
    """A text passes if ``measure op bound`` holds; a ratio over nothing counts as 0."""

    measure: str
    op: str
    bound: float


#: Length, symbol, stop-word and line ratios of running prose, with room on both sides.
RULES = (
    Rule("mean_word_chars", ">=", 2.0),
    Rule("mean_word_chars", "<=", 20.0),
    Rule("symbol_ratio", "<=", 0.1),
    Rule("stop_word_ratio", ">=", 0.01),
    Rule("dup_line_ratio", "<=", 0.5),
)


def _repeat_words(hashes: str) -> list[tuple[str, Column]]:
    """Columns, one after the other, that end in the number of words inside 3-word windows seen
    twice or more: equal window hashes meet by sorting; texts without repeats skip the sort."""
    n = F.size(hashes)
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    same = lambda k, e: F.coalesce(F.get("_s", k)["h"] == e["h"], F.lit(False))
    twice = F.filter("_s", lambda e, k: same(k - 1, e) | same(k + 1, e))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(
        F.transform("_p", lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return [("_g", windows), ("_s", pairs), ("_p", starts), ("n_repeat_words", covered)]


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _unlisted(docs: DataFrame, lang: str | None) -> Column:
    """Whether a row's text (``_t``) is in a language without a list of stop words: by the column
    ``lang`` if the table has one and it is filled, or because letters of other scripts outnumber the
    Latin ones."""
    said = F.lower(F.regexp_extract(F.col("_row")[lang].cast("string"), r"^\s*([A-Za-z]+)", 1)) \
        if lang in docs.columns else F.lit("")
    latin, all_ = (F.regexp_count("_t", F.lit(x)) for x in (r"\p{IsLatin}", r"\p{L}"))
    return (F.coalesce(said, F.lit("")) != "") & ~said.isin(*STOP_WORD_LANGUAGES, "und") | (2 * latin < all_)


def _measured(docs: DataFrame, text: str, rules, lang: str | None) -> DataFrame:
    """``_row`` (the input row), the counts, ``base_failed`` and ``kept``."""
    df = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words(F.col("_t")))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    })
    # only asked where the rule would reject the text
    few = [r for r in rules if r.measure == "stop_word_ratio"]
    df = df.withColumn("stop_word_ratio", _ratio("n_stop_words", "n_words"))
    failed = F.lit(False)
    for r in few:
        failed = failed | ~_OPS[r.op](F.col(r.measure), F.lit(r.bound))
    df = df.withColumn("_free", F.when(failed, _unlisted(docs, lang)).otherwise(F.lit(False)))
    df = df.drop("_w", "_t").withColumns({
        "n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")
    for name, col in _repeat_words("_h"):
        df = df.withColumn(name, col)
    df = df.withColumns({
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    })
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True)
    for r in rules:
        passed = _OPS[r.op](F.col(r.measure), F.lit(r.bound))
        verdict = verdict & (passed | F.col("_free") if r in few else passed)
    return df.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & verdict)


def quality_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   rules=RULES, lang: str | None = "lang") -> DataFrame:
    """One row per input row: the id, ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words``, the ratios, ``base_failed`` and ``kept``.

    The stop-word rule holds for the languages of ``STOP_WORD_LANGUAGES`` only. Texts in another
    language, by the column ``lang`` or, whatever it says, by a script other than Latin, pass on the
    remaining rules; a Latin text of unknown language is held to the list. A NULL or empty text has no words, so it fails the base rule. Repeated rows are scored one by
    one, an empty table gives no rows, and further columns are ignored whatever their names.
    """
    return _measured(docs, text, rules, lang).select(
        F.col("_row")[doc_id].alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept",
        "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio")


def quality_filter(docs: DataFrame, text: str = "text", rules=RULES, lang: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; edge cases as in quality_scores."""
    # a plain filter would be pushed below the measures, each written out again inside the next
    df = _measured(docs, text, rules, lang)
    none = F.array().cast(ArrayType(df.schema["_row"].dataType))
    return df.select(F.inline(F.when(F.col("kept"), F.array("_row")).otherwise(none)))
