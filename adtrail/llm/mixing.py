"""Mixing sources to target weights.

The words of each source, in document order, are packed into blocks of fixed length. A target per
source fixes how many block slots it gets; each source draws multinomial counts of its slots over
the output shards, slots map to blocks through a pseudorandom permutation per source and pass, and
blocks are joined by index. All totals are exact, and everything follows from the seed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from adtrail.llm.text import word_count, words
from adtrail.plans.cut import materialise
from adtrail.plans.groups import number_rows, shuffle_width

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_PASSES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 16384
SEED = 20240229


def _source_key(source: str) -> Column:
    """Sorts by code point with NULL last; equal keys are equal sources."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def source_targets(sized: DataFrame, weights=WEIGHTS, budget=BUDGET, max_passes=MAX_PASSES) -> DataFrame:
    """``sized(_s, size)`` to one row per source: ``source_size`` and ``target`` in words.

    Sources fill up together in proportion to their weights until one is full. Sorted by how early
    they fill, the level reached with the first k full is largest at the true k. The sorted sources
    are stored, and sums per partition carry the running sums across.
    """
    sources = sized.groupBy("_s").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = number_rows(sources, ["_s"], "_rank", start=1).withColumns({
        "_w": w, "_cap": F.col("source_size") * F.lit(float(max_passes))}).withColumn(
        "_early", F.col("_cap") / F.col("_w"))
    order = ["_early", "_rank"]
    placed = materialise(
        ranked.repartitionByRange(shuffle_width(sized), *order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id()))
    # one row per partition
    sums = placed.groupBy("_pid").agg(
        F.sum("source_size").alias("_n"), F.sum("_cap").alias("_caps"), F.sum("_w").alias("_ws"))
    parts = Window.orderBy("_pid")
    full = F.sum("_caps").over(parts.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum("_ws").over(parts.rowsBetween(1, Window.unboundedFollowing))
    over = sums.select("_pid", F.coalesce(full, F.lit(0.0)).alias("_full"),
                       F.coalesce(rest, F.lit(0.0)).alias("_rest"))
    total = sums.agg(F.sum("_n").alias("n")).first()["n"]
    early = Window.partitionBy("_pid").orderBy(*order)
    before = F.coalesce(F.sum("_cap").over(early.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(early.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(float(budget) * (total or 0)) - F.col("_full") - before) / (F.col("_rest") + after)
    levels = placed.join(F.broadcast(over), "_pid").select(level.alias("_level"))
    top = levels.agg(F.max("_level").alias("x")).first()["x"]
    return placed.select(
        "_s", "source_size", F.least("_cap", F.lit(top).cast("double") * F.col("_w")).alias("target"))


def _place(docs: DataFrame, doc_id: str, text: str, source: str,
           keep: bool) -> tuple[DataFrame, DataFrame]:
    """Documents with their first word's position inside their source (``_off``).

    Sorted by source and id over range partitions and stored; one offset per partition and source
    then carries the running sum across, so that a source of any size is split. Repeated rows are
    separate documents; identical ones can be swapped without changing the result.
    """
    cols = [_source_key(source).alias("_s"), F.col(doc_id).alias("doc_id"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.col(text).cast("string")).alias("_tie")]
    if keep:
        cols.append(F.struct("*").alias("_row"))
    order = ["_s", "doc_id", "size", "_tie"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialise(
        docs.select(*cols).repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    small = stored.select("_id", "_pid", "_s", "doc_id", "size")
    here = Window.partitionBy("_pid", "_s").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    chunks = small.groupBy("_pid", "_s").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("_pid", "_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = small.withColumn("_in", F.coalesce(F.sum("size").over(here), F.lit(0))).join(
        starts, ["_pid", "_s"]).withColumn("_off", F.col("_start") + F.col("_in"))
    placed = placed.select("_id", "_s", "doc_id", "size", "_off")
    return placed, stored


def _plan(targets: DataFrame, block_words: int, max_passes: int) -> DataFrame:
    """Blocks and slots per source: as many slots as come nearest to the target."""
    blocks = F.ceil(F.col("source_size") / block_words)
    return targets.withColumn("_blocks", blocks).withColumn("_slots", F.when(
        F.col("_blocks") > 0, F.least(
            F.round(F.col("target") * F.col("_blocks") / F.col("source_size")).cast("long"),
            F.col("_blocks") * max_passes)).otherwise(F.lit(0).cast("long")))


def _key(name: str, *more: int) -> int:
    h = np.uint64(1469598103934665603)
    with np.errstate(over="ignore"):
        for x in [*name.encode(), *more]:
            h = (h ^ np.uint64(x & (2**64 - 1))) * np.uint64(1099511628211)
    return int(h)


def _draw(batches, seed: int, piece: int = 1 << 16):
    """For each source, multinomial counts of its slots over the shards, with the first slot of
    each shard; many shards are drawn piece by piece, each piece's total binomial."""
    for df in batches:
        for r in df.itertuples(index=False):
            rng = np.random.Generator(np.random.PCG64(_key(r._0, seed)))
            left, start, first = int(r._1), 0, 0
            shards = int(r._2)
            while first < shards:
                k = min(piece, shards - first)
                total = left if first + k == shards else int(rng.binomial(left, k / (shards - first)))
                n = rng.multinomial(total, np.full(k, 1.0 / k))
                at = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                yield pd.DataFrame({"_s": r._0, "_blocks": r._3, "shard": np.arange(first, first + k),
                                    "_first": at, "_n": n})[n > 0]
                left, start, first = left - total, start + total, first + k


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network over the next even
    number of bits, walked until the value is below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> shift, x[todo] & low
            for r in range(4):
                k = np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))
                left, right = right, left ^ (_mix64(right + k) & low)
            y = (left << shift) | right
            x[todo] = y
            todo[todo] = y >= np.uint64(n)
    return x.astype(np.int64)


def _map_slots(batches, seed: int, most: int = 1 << 18):
    for df in batches:
        for r in df.itertuples(index=False):
            name, blocks, shard, first, n = r
            for a in range(first, first + n, most):
                slot = np.arange(a, min(a + most, first + n))
                turn = slot // blocks
                block = np.empty_like(slot)
                for p in np.unique(turn):
                    at = turn == p
                    block[at] = permute(slot[at] % blocks, blocks, _key(name, seed, int(p)))
                yield pd.DataFrame({"_s": name, "shard": shard, "slot": slot, "_block": block})


def _slots(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot: source, shard, slot number in the source, block."""
    slots = plan.agg(F.sum("_slots").alias("n")).first()["n"] or 0
    shards = F.lit(max(1, -(-slots // shard_slots))).cast("long")
    rows = plan.where("_slots > 0").select(
        F.col("_s").alias("_0"), F.col("_slots").alias("_1"), shards.alias("_2"),
        F.col("_blocks").alias("_3"))
    drawn = rows.mapInPandas(partial(_draw, seed=seed),
                             "_s string, _blocks long, shard long, _first long, _n long")
    width = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark would take the slots for as small as the plan they grow from and broadcast them
    return drawn.repartition(width, "_s", "shard").mapInPandas(
        partial(_map_slots, seed=seed), "_s string, shard long, slot long, _block long").hint("merge")


def _mixed(docs, doc_id, text, source, weights, budget, max_passes, block_words, shard_slots, seed,
           keep):
    placed, stored = _place(docs, doc_id, text, source, keep)
    plan = materialise(_plan(source_targets(placed, weights, budget, max_passes), block_words, max_passes))
    slots = _slots(plan, shard_slots, seed)
    last = F.col("_off") + F.col("size") - 1
    pieces = placed.withColumn("_block", F.explode_outer(F.when(
        F.col("size") > 0, F.sequence((F.col("_off") / block_words).cast("long"),
                                      (last / block_words).cast("long")))))
    low = F.greatest(F.col("_off"), F.col("_block") * block_words)
    high = F.least(last + 1, (F.col("_block") + 1) * block_words)
    pieces = pieces.withColumns({"_from": low - F.col("_off"), "_words": high - low})
    return placed, stored, plan, slots, pieces


def mixture_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   source: str = "source", weights=WEIGHTS, budget=BUDGET, max_passes=MAX_PASSES,
                   block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken`` (words, repeats counted).

    A NULL or empty text has size 0 and takes nothing; a NULL source is a source of its own, sorted
    last; repeated rows are documents of their own; an empty table gives no rows; further columns
    are ignored whatever their names.
    """
    _, _, plan, slots, pieces = _mixed(docs, doc_id, text, source, weights, budget, max_passes,
                                       block_words, shard_slots, seed, keep=False)
    times = slots.groupBy("_s", "_block").agg(F.count(F.lit(1)).alias("_times")).hint("merge")
    taken = F.coalesce(F.sum(F.col("_words") * F.col("_times")), F.lit(0)).cast("long")
    counts = pieces.join(times, ["_s", "_block"], "left").groupBy("_id", "_s").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), taken.alias("taken"))
    return counts.join(plan.select("_s", "source_size", "target"), "_s").select(
        F.col("doc_id").alias(doc_id), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  source: str = "source", n_chars: str = "n_chars", weights=WEIGHTS, budget=BUDGET,
                  max_passes=MAX_PASSES, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS,
                  seed=SEED) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per document and pass that takes
    words of it. The whole text stands if the pass takes all its words, else the words taken, with
    one space between them; ``n_chars`` follows the text. Documents without words have no blocks
    and do not appear. Otherwise as ``mixture_counts``."""
    _, stored, _, slots, pieces = _mixed(docs, doc_id, text, source, weights, budget, max_passes,
                                         block_words, shard_slots, seed, keep=True)
    times = slots.groupBy("_s", "_block").agg(F.count(F.lit(1)).cast("int").alias("_times")).hint("merge")
    per_doc = pieces.where("size > 0").join(times, ["_s", "_block"], "left").groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("_block", F.coalesce("_times", F.lit(0)).alias("n"))))
        .alias("_b"), F.first("_off").alias("_off"))
    per_doc = per_doc.select("_id", F.pmod("_off", F.lit(block_words)).alias("_lead"),
                             F.col("_b.n").alias("_b")).where(F.array_max("_b") > 0)
    df = stored.select("_id", "_row").join(per_doc, "_id")
    df = df.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.array_max("_b"))))
    part = F.filter(words(F.col("_row")[text]), lambda w, i: F.get(
        "_b", ((F.col("_lead") + i) / block_words).cast("int")) >= F.col("_pass"))
    df = df.withColumn("_text", F.when(
        F.array_min("_b") >= F.col("_pass"), F.col("_row")[text]).otherwise(F.array_join(part, " ")))
    new = {text: F.col("_text"), n_chars: F.length("_text").cast("long")}
    return df.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def mixture_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   source: str = "source", weights=WEIGHTS, budget=BUDGET, max_passes=MAX_PASSES,
                   block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED) -> DataFrame:
    """The mix as training blocks: ``shard, source, slot, words`` with ``block_words`` words each
    (fewer in a source's last block). Edge cases as in ``mixture_counts``."""
    _, stored, _, slots, pieces = _mixed(docs, doc_id, text, source, weights, budget, max_passes,
                                         block_words, shard_slots, seed, keep=True)
    parts = pieces.where("size > 0").join(
        stored.select("_id", words(F.col("_row")[text]).alias("_all")), "_id").select(
        "_s", "_block", "_id", F.slice("_all", (F.col("_from") + 1).cast("int"),
                                       F.col("_words").cast("int")).alias("_part"))
    blocks = parts.groupBy("_s", "_block").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("_id", "_part"))), lambda x: x["_part"])).alias("words"))
    name = F.when(F.col("_s") != "1", F.substring("_s", 2, 2**31 - 1))
    return slots.join(blocks, ["_s", "_block"]).select("shard", name.alias("source"), "slot", "words")
