"""Joins of 128-bit hashes within a Hamming distance.

Two hashes that differ in at most ``k`` bits agree on at least one of ``k + 1`` disjoint bands,
so a theta join becomes an equi-join on (band, value) with an exact distance check. A pair is
reported only in the first band it shares, so no ``distinct`` is needed.

Bits are dealt to the bands by how evenly they are set in the data, so that constant bits, which tell
nothing, are shared out and every band holds as many telling ones. A lookup of many hashes in few
(`near_known`) halves the bands: two hashes differ in at most one bit in one of them, and the few are
entered with all their one-bit variants.

A bucket with too many candidate pairs is split again by ``k + 1`` bands over the bits that the
bucket has not fixed yet, and so on; what is still large after the last round is spread over a
grid of cells in which every pair of rows meets once. Nothing is capped or left out.

Where the bands hold so few bits that most pairs share one, as for a radius of a quarter of the bits that
vary, a self-join compares all pairs in blocks of `BLOCK` points, each pair once, with numpy inside the tasks.

The rows are multiplied by their bands and variants, of which Spark's size estimates know nothing, so the
joins on buckets are asked to shuffle: a side taken for small would be broadcast at its full size.
"""

from __future__ import annotations

from functools import partial
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adtrail.functions.bits import HASH_BITS, _signed, distance, first_shared_band
from adtrail.plans.cut import materialise

BUCKET_LIMIT = 8192
ORDER_ROWS = 4096     # points of a side that the bit order is taken from
BLOCK = 16_384        # points of a side in one cell of a comparison of all pairs
STRIP = 128           # of which so many at a time meet the other side
NARROW = 5            # bits of a band that hardly tell points apart
ROW_COST = 8          # a joined candidate costs at least so many plain comparisons
MAX_TASKS = 2000      # that the cells are dealt to
MAX_PATHS = 50_000    # size of the mask table: seven bands allow five rounds, fourteen four
_KEY = ["_path", "_kh", "_kl"]


def bit_order(*points: DataFrame) -> list[int]:
    """All bits, from the one that is set most evenly to those that never vary, by a few thousand
    points of each side; the order steers the plan only, never the result."""
    rows = [r for p in points for r in p.select("hi", "lo").limit(ORDER_ROWS).collect()]
    lanes = np.array([(r.lo, r.hi) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
    ones = (lanes[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0).ravel()
    return sorted(range(HASH_BITS), key=lambda b: (abs(2 * int(ones[b]) - len(rows)), -b))


def _split_mask(free: int, n: int, order: Sequence[int]) -> list[int]:
    """Deal the set bits of a 128-bit mask into ``n`` masks, in turn."""
    bits = [b for b in order if free >> b & 1]
    return [sum(1 << b for b in bits[i::n]) for i in range(n)]


def _lanes(mask: int) -> tuple[int, int]:
    return _signed(mask >> 64), _signed(mask & ((1 << 64) - 1))


class _Paths:
    """The tree of band masks: a path fixes bits, its children split the bits that are free."""

    def __init__(self, n: int, order: Sequence[int]):
        self.n, self.order = n, order
        self.full = (1 << HASH_BITS) - 1
        self.masks = _split_mask(self.full, n, order)
        self.levels: list[list[dict]] = [
            [{"path": i, "fixed": mask, "before": self.masks[:i]} for i, mask in enumerate(self.masks)]]

    def children(self, level: int) -> list[dict]:
        while len(self.levels) <= level:
            grown = []
            base = sum(len(x) for x in self.levels)
            for parent in self.levels[-1]:
                parts = _split_mask(self.full & ~parent["fixed"], self.n, self.order)
                for j, part in enumerate(parts):
                    grown.append({"path": base + len(grown), "parent": parent["path"],
                                  "fixed": parent["fixed"] | part,
                                  "before": parent["before"] + parts[:j]})
            self.levels.append(grown)
        return self.levels[level]


def _level_one(points: DataFrame, paths: _Paths) -> DataFrame:
    return _level_one_of(points, [(p["path"], p["fixed"], 0) for p in paths.levels[0]])


def _next_level(rows: DataFrame, paths: _Paths, level: int) -> DataFrame:
    """Replace the bucket of each row by its child buckets (a fixed table of masks)."""
    table = [(c["parent"], c["path"], *_lanes(c["fixed"])) for c in paths.children(level)]
    masks = rows.sparkSession.createDataFrame(table, "_path int, _new int, _mh long, _ml long")
    base = [c for c in rows.columns if c not in _KEY]
    return rows.join(F.broadcast(masks), "_path").select(
        *base, F.col("_new").alias("_path"),
        F.col("hi").bitwiseAND(F.col("_mh")).alias("_kh"),
        F.col("lo").bitwiseAND(F.col("_ml")).alias("_kl"))


def _heavy(left: DataFrame, right: DataFrame | None, limit: int) -> DataFrame:
    """Buckets whose candidate pairs exceed ``limit`` squared."""
    l = left.groupBy(*_KEY).agg(F.count(F.lit(1)).cast("double").alias("_nl"))
    if right is None:
        return l.withColumn("_nr", F.col("_nl")).where(F.col("_nl") > limit)
    r = right.groupBy(*_KEY).agg(F.count(F.lit(1)).cast("double").alias("_nr"))
    return l.hint("merge").join(r.hint("merge"), _KEY).where(F.col("_nl") * F.col("_nr") > float(limit) ** 2)


def _grid(rows: DataFrame, heavy: DataFrame, limit: int, side: str) -> DataFrame:
    """Spread the rows of heavy buckets over cells; other rows stay in cell (0, 0)."""
    joined = rows.join(heavy, _KEY, "left")
    mine, other = ("_nl", "_nr") if side == "a" else ("_nr", "_nl")

    def blocks(n: str) -> Column:
        return F.coalesce(F.ceil(F.col(n) / limit), F.lit(1)).cast("int")

    at = F.pmod(F.xxhash64("hi", "lo", F.lit(side)), blocks(mine)).cast("int")
    spread = joined.withColumn("_me", at).withColumn(
        "_you", F.explode(F.sequence(F.lit(0), blocks(other) - 1)))
    i, j = ("_me", "_you") if side == "a" else ("_you", "_me")
    return spread.withColumn("_i", F.col(i)).withColumn("_j", F.col(j)).drop(
        "_me", "_you", "_nl", "_nr")


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], max_bits: int,
          same: bool) -> DataFrame:
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    cond = None
    for c in on:
        term = F.col(f"a_{c}") == F.col(f"b_{c}")
        cond = term if cond is None else cond & term
    if same:
        cond = cond & ((F.col("a_hi") < F.col("b_hi"))
                       | ((F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") < F.col("b_lo"))))
    bits = distance("a_hi", "a_lo", "b_hi", "b_lo")
    return a.hint("merge").join(b.hint("merge"), cond & (bits <= max_bits)).withColumn("bits", bits.cast("int"))


def candidate_pairs(points: DataFrame, max_bits: int, order: Sequence[int]) -> tuple[int, float]:
    """Number of points, and of pairs that share a band: a bound of what a self-join compares."""
    n = max_bits + 1
    sizes = _level_one(points.select("hi", "lo"), _Paths(n, order)).groupBy(*_KEY).count()
    row = sizes.agg(F.sum("count").alias("rows"), F.sum(
        F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).first()
    return (row["rows"] or 0) // n, row["pairs"] or 0.0


def _cell_pairs(cell: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """All near pairs of one cell: of its two blocks, or inside a block that meets itself."""
    hi, lo = (cell[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
    second = cell["second"].to_numpy()
    own = not second.any()
    mine, other = (np.arange(len(cell)),) * 2 if own else (np.flatnonzero(~second), np.flatnonzero(second))
    parts = []
    for at in range(0, len(mine), STRIP):
        a = mine[at:at + STRIP]
        b = other[at + 1:] if own else other
        bits = np.bitwise_count(lo[a, None] ^ lo[None, b])
        bits += np.bitwise_count(hi[a, None] ^ hi[None, b])
        i, j = np.nonzero(bits <= max_bits)
        if own:
            i, j = i[(later := a[i] < b[j])], j[later]
        parts.append((a[i], b[j], bits[i, j]))
    a, b, bits = (np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (np.empty(0, int),) * 3
    signed = [x.view(np.int64) for x in (hi, lo)]
    # the smaller point first, as signed numbers
    swap = (signed[0][a] > signed[0][b]) | ((signed[0][a] == signed[0][b]) & (signed[1][a] > signed[1][b]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pd.DataFrame({"a_hi": signed[0][a], "a_lo": signed[1][a], "b_hi": signed[0][b], "b_lo": signed[1][b],
                         "bits": bits.astype(np.int32)})


def _all_pairs(points: DataFrame, size: int, max_bits: int, block: int) -> DataFrame:
    """Near pairs of all points by comparing every pair once: cells of two blocks, a block with itself
    included. Memory is bounded by the block, and the cells are independent of each other."""
    n = -(-size // block)
    me, you = F.col("_me"), F.col("_you")
    dealt = points.select("hi", "lo").where("hi is not null and lo is not null").distinct().withColumn(
        "_me", F.pmod(F.xxhash64("hi", "lo"), F.lit(n)).cast("int")).withColumn(
        "_you", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = dealt.select(F.least(me, you).alias("_i"), F.greatest(me, you).alias("_j"), "hi", "lo",
                         (me > you).alias("second"))
    # as many tasks as cells, up to a bound: rows are few for the work, so sizes tell nothing
    tasks = min(n * (n + 1) // 2, MAX_TASKS)
    found = cells.repartition(tasks, "_i", "_j").groupBy("_i", "_j").applyInPandas(
        partial(_cell_pairs, max_bits=max_bits), "a_hi long, a_lo long, b_hi long, b_lo long, bits int")
    for side in "ab":
        named = points.select(*[F.col(c).alias(f"{side}_{c}") for c in points.columns])
        found = found.join(named, [f"{side}_hi", f"{side}_lo"])
    return found.select(*[f"{s}_{c}" for s in "ab" for c in points.columns], "bits")


def near_pairs(left: DataFrame, right: DataFrame | None, max_bits: int,
               limit: int = BUCKET_LIMIT, candidates: float | None = None,
               order: Sequence[int] | None = None, block: int | None = None) -> DataFrame:
    """All pairs of rows of ``left`` and ``right`` within ``max_bits``.

    Both sides hold one row per hash (columns ``hi``, ``lo`` and any others). With
    ``right=None`` the pairs are those inside ``left``, each once. Output: every input column
    with prefix ``a_`` or ``b_``, and ``bits``. ``candidates`` is the number of pairs that share
    a band and ``order`` the `bit_order`, where the caller knows them already; ``block`` bounds the
    points of a side that meet at a time where all pairs are compared.
    """
    same = right is None
    n = max_bits + 1
    block = block or BLOCK
    order = bit_order(*[p for p in (left, right) if p is not None]) if order is None else order
    if same and (2 * candidates if candidates is not None else float(left.count()) ** 2) > float(limit) ** 2:
        ends = [f(c) for f in (F.bit_or, F.bit_and) for c in ("hi", "lo")]
        if (left.agg(distance(*ends)).first()[0] or 0) <= NARROW * n:
            size, candidates = candidate_pairs(left, max_bits, order)
            if ROW_COST * candidates > size * (size - 1) / 2:
                return _all_pairs(left, size, max_bits, block)
    paths = _Paths(n, order)
    l1 = _level_one(left, paths)
    r1 = l1 if same else _level_one(right, paths)
    spark = left.sparkSession

    def simple(a: DataFrame, b: DataFrame) -> DataFrame:
        found = _join(a, b, _KEY, max_bits, same)
        first = first_shared_band("a_hi", "a_lo", "b_hi", "b_lo", [_lanes(m) for m in paths.masks])
        return found.where(first == F.col("a__path"))

    if candidates is None:
        size_l = left.count()
        candidates = size_l * (size_l if same else right.count()) / 2
    heavy = None
    # no bucket can be heavy while all of them together hold fewer pairs
    if 2 * candidates > limit * limit:
        heavy = _heavy(l1, None if same else r1, limit)
        heavy = materialise(heavy)
        heavy = None if heavy.isEmpty() else heavy
    if heavy is None:
        found = simple(l1, r1)
    else:
        parts, a, b = [], l1, r1
        level = 0
        while not heavy.isEmpty() and n ** (level + 2) <= MAX_PATHS:
            level += 1
            key = heavy.select(*_KEY)
            parts.append(_join(a.join(key, _KEY, "left_anti"), b.join(key, _KEY, "left_anti"),
                               _KEY, max_bits, same))
            a = materialise(_next_level(a.join(key, _KEY, "left_semi"), paths, level))
            b = a if same else materialise(
                _next_level(b.join(key, _KEY, "left_semi"), paths, level))
            heavy = materialise(_heavy(a, None if same else b, limit))
        if heavy.isEmpty():
            parts.append(_join(a, b, _KEY, max_bits, same))
        else:
            cells = _join(_grid(a, heavy, limit, "a"), _grid(b, heavy, limit, "b"),
                          [*_KEY, "_i", "_j"], max_bits, same)
            parts.append(cells.drop("a__i", "a__j", "b__i", "b__j"))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        before = spark.createDataFrame(
            [(p["path"], [_lanes(m) for m in p["before"]])
             for level in paths.levels for p in level],
            "_p int, _before array<struct<h:long,l:long>>")
        dh, dl = (F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in ("hi", "lo"))
        earlier = F.exists("_before", lambda m: dh.bitwiseAND(m["h"]).bitwiseOR(
            dl.bitwiseAND(m["l"])) == 0)
        found = found.join(F.broadcast(before), F.col("a__path") == F.col("_p")).where(
            ~earlier).drop("_p", "_before")
    return found.drop(*[f"{s}_{k}" for s in "ab" for k in _KEY])


def near_known(left: DataFrame, right: DataFrame, max_bits: int, limit: int = BUCKET_LIMIT) -> DataFrame:
    """`near_pairs` of many hashes with few known ones: ``left`` has one row per hash and band, and
    ``right``, the smaller side, all values within one bit of its own.

    With half as many bands as differing bits allowed, some band differs in at most one bit. A pair
    counts in the first such band. Buckets with too many candidates are spread over cells.
    """
    order = bit_order(left, right)
    masks = _split_mask((1 << HASH_BITS) - 1, max_bits // 2 + 1, order)
    mine = _level_one_of(left, [(i, m, 0) for i, m in enumerate(masks)])
    flips = [(i, m, 1 << b if b >= 0 else 0) for i, m in enumerate(masks)
             for b in [-1, *(b for b in range(HASH_BITS) if m >> b & 1)]]
    theirs = _level_one_of(right, flips)
    heavy = None
    # no bucket can be heavy while all pairs together are too few
    if float(left.count()) * right.count() > float(limit) ** 2:
        heavy = materialise(_heavy(mine, theirs, limit))
        heavy = None if heavy.isEmpty() else heavy
    if heavy is None:
        found = _join(mine, theirs, _KEY, max_bits, False)
    else:
        found = _join(_grid(mine, heavy, limit, "a"), _grid(theirs, heavy, limit, "b"),
                      [*_KEY, "_i", "_j"], max_bits, False).drop("a__i", "a__j", "b__i", "b__j")
    dh, dl = (F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in ("hi", "lo"))
    first = None
    for i, m in enumerate(masks):
        h, l = (F.lit(x).cast("bigint") for x in _lanes(m))
        close = F.bit_count(dh.bitwiseAND(h)) + F.bit_count(dl.bitwiseAND(l)) <= 1
        first = F.when(close, i) if first is None else first.when(close, i)
    return found.where(first == F.col("a__path")).drop(*[f"{s}_{k}" for s in "ab" for k in _KEY])


def _level_one_of(points: DataFrame, entries: Sequence[tuple[int, int, int]]) -> DataFrame:
    """One row per entry (band, mask, flipped bit) and point, with the band's value as the key."""
    table = [F.struct(F.lit(i).alias("p"), *[F.lit(x).cast("bigint").alias(c) for c, x in zip(
        ("h", "l", "fh", "fl"), (*_lanes(mask), *_lanes(flip)))]) for i, mask, flip in entries]
    return points.withColumn("_b", F.explode(F.array(*table))).select(
        *points.columns, F.col("_b.p").alias("_path"),
        F.col("hi").bitwiseAND(F.col("_b.h")).bitwiseXOR(F.col("_b.fh")).alias("_kh"),
        F.col("lo").bitwiseAND(F.col("_b.l")).bitwiseXOR(F.col("_b.fl")).alias("_kl"))
