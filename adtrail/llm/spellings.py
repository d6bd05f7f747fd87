"""Spelling variants among all words of a corpus.

Every rotation of a word and its terminator is a row. Cut before its last character, a rotation stands
for its word without that character; words that share such a prefix differ by a replacement there, and
a whole rotation equal to a prefix is the word with the character deleted. So the rotations are
shuffled and sorted by prefix, and one scan of each group of equal prefixes finds every member's best
neighbour and counts its neighbours, without listing pairs. A group has one member per character of
the alphabet at most.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adtrail.plans.cut import materialise
from adtrail.plans.groups import number_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A-Z to a-z in UTF-8; all other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TERMINATOR = "$"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
DAMAGE = 97
#: Characters of a rotation that its key holds as they are; the rest goes in as a hash of 128 bits, so
#: that a row's size does not depend on the word's length.
HEAD = 32
#: Entries that a task holds before it passes its sums on.
HELD = 400_000

WHOLE, INSIDE, RUN_START = 0, 1, 2


def damaged(doc_id: str, run: str, every: int = DAMAGE) -> str:
    """``run`` without one character, if ``every`` divides the checksum of id and run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(batches, every: int, held: int):
    """Batches (id, text) to sums (word, n) over runs of documents."""
    total = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])
        total.clear()
        return out

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            runs = Counter(RUN.findall(text.as_py().translate(LOWER).decode()))
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in runs.items():
                hit = zlib.crc32(run.encode(), start) % every == 0
                total[damaged(doc_id, run, every) if hit else run] += n
        if len(total) > held:
            yield flush()
    yield flush()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = DAMAGE,
                held: int = HELD) -> DataFrame:
    """(word, n) over all runs of letters of all texts, lower-cased in A-Z and some of them damaged; a
    NULL id counts as empty, a NULL text has no words, and repeated rows count each."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    counted = rows.mapInArrow(partial(_count, every=every, held=held), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _rotations(words: DataFrame) -> DataFrame:
    """``words(word, id)`` to (key, id, kind): each whole rotation, and each rotation before its last
    character, unless that is the terminator. In a run of equal characters only the first stands for
    the deletion, so that a pair meets once."""
    size = F.length("word")
    twice = F.concat("word", F.lit(TERMINATOR), "word", F.lit(TERMINATOR))

    def key(at, length):
        rest = F.substring(F.col("_d"), at + HEAD, length - HEAD)
        hashed = F.concat_ws("#", F.substring(F.col("_d"), at, F.lit(HEAD)), length,
                             F.xxhash64(F.lit(1), rest), F.xxhash64(F.lit(2), rest))
        return F.when(length <= HEAD, F.substring(F.col("_d"), at, length)).otherwise(hashed)

    def row(at, length, kind):
        return F.struct(key(at, length).alias("key"), kind.alias("kind"))

    again = lambda i: F.substring("_d", i, F.lit(1)) == F.substring("_d", i - 1, F.lit(1))
    whole = F.transform(F.sequence(F.lit(1), F.col("_n") + 1), lambda i: row(i, F.col("_n") + 1, F.lit(WHOLE)))
    cut = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: row(
        i + 1, F.col("_n"), F.when((i > 1) & again(i), INSIDE).otherwise(RUN_START)))
    rows = words.where(size > 0).withColumns({"_d": twice, "_n": size})
    return rows.select("id", F.explode(F.concat(whole, cut)).alias("_r")).select("_r.key", "id", "_r.kind")


def near_words(words: DataFrame) -> DataFrame:
    """``words(word, id)``, distinct words without the terminator, to (id, n_near, best): how many of
    them differ from the word by one character inserted, deleted or replaced, and the smallest id
    among these; words without any are left out."""
    ranked = Window.partitionBy("key").orderBy(F.col("kind") == WHOLE, "id")
    group = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_cut, is_start = F.col("kind") != WHOLE, F.col("kind") == RUN_START
    # the cut rotations by id, then the whole one, if there is one
    scanned = _rotations(words).withColumns({
        "_size": F.count(F.lit(1)).over(group), "_cuts": F.count_if(is_cut).over(group),
        "_starts": F.count_if(is_start).over(group), "_first": F.first("id").over(group),
        "_start": F.min(F.when(is_start, F.col("id"))).over(group),
        "_whole": F.max(F.when(~is_cut, F.col("id"))).over(group),
        "_at": F.row_number().over(ranked), "_next": F.lead("id").over(ranked)}).where("_size > 1")
    other_cut = F.when(F.col("_at") > 1, F.col("_first")).otherwise(F.when(F.col("_cuts") > 1, F.col("_next")))
    found = scanned.select(
        "id",
        F.when(~is_cut, F.col("_starts")).otherwise(
            F.col("_cuts") - 1 + (is_start & F.col("_whole").isNotNull()).cast("long")).alias("k"),
        F.when(~is_cut, F.col("_start")).otherwise(
            F.least(other_cut, F.when(is_start, F.col("_whole")))).alias("best"))
    return found.where("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``forms(id, form)`` to (id, root). A form occurs at least ``RATIO`` times as often as its word, so
    chains are short; each round doubles the steps taken."""
    state = materialise(forms.select("id", F.col("form").alias("root")))
    while True:
        step = state.select(F.col("id").alias("root"), F.col("root").alias("_to"))
        moving = state.join(step, "root")
        if moving.isEmpty():
            return state
        state = materialise(state.join(step, "root", "left").select("id", F.coalesce("_to", "root").alias("root")))


def variant_groups(counts: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                   ratio: float = RATIO) -> DataFrame:
    """``counts(word, n)`` to ``word, form, root, n, n_near, form_n`` of every word of at least
    ``min_length`` code points and ``min_count`` occurrences.

    ``form`` is the near word of largest n (ties: smallest in code-point order), if that n is at least
    ``ratio`` (over 1) times the word's; ``root`` is where the forms lead. Words may have any length
    and must not hold the terminator. Equal words are added up, NULL words left out, and an empty table
    gives no rows.
    """
    if ratio <= 1:
        raise ValueError("forms must occur more often than their words")
    words = counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(
        (F.length("word") >= min_length) & (F.col("n") >= min_count))
    # numbered by preference, so that the best neighbour is the one of smallest id
    words = number_rows(words.withColumn("_less", -F.col("n")), ["_less", "word"], "id").select("word", "n", "id")
    words = materialise(words)
    near = near_words(words)
    best = words.select(F.col("id").alias("best"), F.col("word").alias("_form"), F.col("n").alias("_form_n"))
    found = materialise(near.join(best, "best").join(words, "id").select(
        "id", "n_near", *[F.when(F.col("_form_n") >= ratio * F.col("n"), F.col(c)).alias(name)
                          for c, name in (("best", "form_id"), ("_form", "form"), ("_form_n", "form_n"))]))
    roots = _roots(found.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select(
        "id", F.col("_root").alias("root"))
    return words.join(found, "id", "left").join(named, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
