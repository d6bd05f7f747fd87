"""How the sources of a language differ in their words.

One translate table lower-cases letters and blanks separators of a text's UTF-8 bytes, a split gives
its terms and a Counter their frequencies. Each task adds up the counters of its documents by
language and source before anything is shuffled. Sources are compared in tiles: a task gets a few
hundred terms and two groups of sources of one language, whatever the table's size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adtrail.plans.cut import materialise
from adtrail.plans.groups import top_per

#: A-Z to a-z; a-z and all bytes outside ASCII stay; anything else separates.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIN_DOCS = 30
SMOOTHING = 5
TOP_TERMS = 50
#: Entries that a task holds before it passes its sums on.
HELD = 400_000
TILE_TERMS = 256
TILE_SOURCES = 128


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _count(batches, held: int):
    """Batches (lang, source, text) to sums (lang, source, term, n, docs) over runs of documents."""
    n, docs = defaultdict(Counter), defaultdict(Counter)

    def flush():
        for (lang, source), counts in n.items():
            seen = docs[lang, source]
            size = len(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()),
                pa.array([seen[t] for t in counts], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2).cast(pa.binary())):
            counts = Counter(terms(text.as_py()))
            if counts:
                n[lang, source].update(counts)
                docs[lang, source].update(counts.keys())
        if sum(map(len, n.values())) > held:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``docs(lang, source, text)`` without NULLs to (lang, source, term, n, docs), one row each."""
    summed = docs.select("lang", "source", "text").mapInArrow(
        partial(_count, held=held), "lang string, source string, term string, n long, docs long")
    # a term has at most one row per source and task, so the key is never hot
    return summed.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) for count <= total, by long division in steps of 1000, so
    that no product leaves 64 bits; 1 where total is 0."""
    out, rest = F.lit(0).cast("long"), count
    total = F.nullif(total, F.lit(0).cast("long"))
    for _ in range(3):
        # quotient and rest of the next three digits
        up = rest * F.lit(1000).cast("long")
        digits = F.call_function("div", up, total)
        out, rest = out * F.lit(1000).cast("long") + digits, F.pmod(up, total)
    return F.coalesce(out, F.lit(0).cast("long")) + 1


def _distances(cell: pd.DataFrame) -> pd.DataFrame:
    """One cell: its sources' shares of a block of terms, to the distance of each pair. Rows without a
    term carry a source's base, its share of any term that it does not hold. The first block starts
    with the distance of the bases over all ``V`` terms; terms held in the cell replace theirs."""
    marks = cell[cell["term"].isna()].sort_values("source").reset_index(drop=True)
    rows = cell[cell["term"].notna()]
    at = pd.Series(marks.index.to_numpy(), index=marks["source"])
    codes, found = pd.factorize(rows["term"])
    shares = np.repeat(marks["p"].to_numpy(np.int64)[:, None], len(found), axis=1)
    shares[at[rows["source"]].to_numpy(), codes] = rows["p"].to_numpy(np.int64)
    left = np.flatnonzero(marks["tile"] == cell["ti"].iloc[0])
    right = np.flatnonzero(marks["tile"] == cell["tj"].iloc[0])
    same = cell["ti"].iloc[0] == cell["tj"].iloc[0]
    base = marks["p"].to_numpy(np.int64)
    rest = (int(marks["V"].iloc[0]) if cell["block"].iloc[0] == 0 else 0) - len(found)
    out = []
    for i in left:
        js = right[right > i] if same else right
        f = np.abs(shares[js] - shares[i]).sum(axis=1) + rest * np.abs(base[js] - base[i])
        out.append(pd.DataFrame({"a": i, "b": js, "f": f}))
    pairs = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "f": []})
    names = marks["source"].to_numpy(object)
    return pd.DataFrame({"lang": cell["lang"].iloc[0], "a": names[pairs["a"].to_numpy(int)],
                         "b": names[pairs["b"].to_numpy(int)], "f": pairs["f"].to_numpy(np.int64)})


def _pairs(shares: DataFrame, groups: DataFrame, tile_terms: int, tile_sources: int) -> DataFrame:
    """Every ordered pair of sources of a language with the sum of its differences."""
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    groups = groups.withColumns({"blocks": F.ceil(F.greatest("V", F.lit(1)) / tile_terms),
                                 "tiles": F.ceil(F.col("S") / tile_sources)}).withColumn("tile", tile)
    marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "block", "tile", "tiles",
        "V")
    # a term that a source does not hold has the source's base share: marks bring it into every cell
    held = shares.join(groups.select("lang", "source", "blocks", "tile", "tiles"), ["lang", "source"]).select(
        "lang", "source", "term", "p", block.alias("block"), "tile", "tiles", F.lit(None).cast("long").alias("V"))
    cells = marks.unionByName(held).withColumn(
        "_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "lang", "source", "term", "p", "block", "tile", "V", F.least("tile", "_o").alias("ti"),
        F.greatest("tile", "_o").alias("tj"))
    found = cells.groupBy("lang", "block", "ti", "tj").applyInPandas(
        _distances, "lang string, a string, b string, f long")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    return sums.select("lang", F.inline(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, top: int = TOP_TERMS,
                      tile_terms: int = TILE_TERMS, tile_sources: int = TILE_SOURCES, held: int = HELD) -> DataFrame:
    """``lang, source, part, item, value, rank``: per group of language and source, in part ``pair``
    the other sources of the language by the distance of their words, in part ``term`` the ``top``
    terms that the group has more often than its language.

    Terms are the runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps those in
    at least ``min_docs`` of its documents. A share is 1 + floor(10**9 * (n + smoothing) / (N +
    smoothing * V)), in exact integers. NULL text, lang and source count as ''. A group without terms
    is compared as well; a language with one source has no pairs; without kept terms distances are 0.
    Repeated rows are separate documents, ties go by UTF-8 order, an empty table gives no rows, and
    further columns are ignored.
    """
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                          for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    per_term = Window.partitionBy("lang", "term")
    kept = materialise(term_counts(clean, held).withColumns({
        "in_docs": F.sum("docs").over(per_term), "lang_n": F.sum("n").over(per_term)}).where(
        F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"))
    vocabulary = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("V"), F.sum("lang_n").alias("lang_N"))
    groups = clean.select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("S"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("N", "V", "lang_N")}
    a = F.lit(smoothing).cast("long")
    groups = materialise(groups.join(sizes, "lang").join(vocabulary, "lang", "left").join(
        totals, ["lang", "source"], "left").withColumns(none).withColumns({
            "total": F.col("N") + a * F.col("V"), "lang_total": F.col("lang_N") + a * F.col("V")}).withColumn(
        "base", _share(a, F.col("total"))))
    shares = kept.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).withColumns({
        "p": _share(F.col("n") + a, F.col("total")), "q": _share(F.col("lang_n") + a, F.col("lang_total"))})
    more = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("p") - F.col("q")).alias("value"))
    pairs = _pairs(shares, groups, tile_terms, tile_sources).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = top_per(more, ["lang", "source"], [F.col("value").desc(), "item"], top, rank="rank")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return best.unionByName(pairs.withColumn("rank", rank))
