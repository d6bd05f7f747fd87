"""Word splitting shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space is space and \\t..\\r; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """All words of a text in order; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """A 64-bit hash per word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
