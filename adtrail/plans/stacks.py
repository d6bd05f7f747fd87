"""Replaying stacks of any length: Begins push, Ends pop if they fit what is on top.

A run of marks reduces to the Ends that find its own stack empty, followed by the Begins that it
leaves open. Such a list is a run again, so reductions of neighbouring chunks can be put together and
reduced further. Chunks are reduced on their own, then level by level up to whole groups; on the way
back every chunk learns which Begins are open before it. All steps are folds over arrays in the JVM.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adtrail.plans.cut import materialise
from adtrail.plans.groups import ordered

CHUNK_ROWS = 512
FAN = 64

Fits = Callable[[Column, Column], Column]


def _pops(stack: Column, r: Column, fits: Fits) -> Column:
    top = F.try_element_at(stack, F.lit(-1))
    return (r["delta"] < 0) & top.isNotNull() & fits(top, r)


def _after(stack: Column, r: Column, fits: Fits) -> Column:
    return F.when(r["delta"] > 0, F.concat(stack, F.array(r))).when(
        _pops(stack, r, fits), F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack)


def _reduced(run: Column, none: Column, fits: Fits) -> Column:
    """The Ends that act on what lies below the run, then the Begins that stay open."""
    def step(acc: Column, r: Column) -> Column:
        below = (r["delta"] < 0) & (F.size(acc["stack"]) == 0)
        return F.struct(_after(acc["stack"], r, fits).alias("stack"),
                        F.when(below, F.concat(acc["below"], F.array(r))).otherwise(acc["below"]).alias("below"))

    return F.aggregate(run, F.struct(none.alias("stack"), none.alias("below")), step,
                       lambda acc: F.concat(acc["below"], acc["stack"]))


def unfit_ends(marks: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str], fits: Fits,
               chunk_rows: int = CHUNK_ROWS, fan: int = FAN, **scan) -> DataFrame:
    """``(*keys, order)`` of the Ends (``delta`` < 0) that meet an open Begin which they do not fit,
    by ``fits(begin, end)``; such an End changes nothing, and neither does one without open Begin.

    ``marks`` has the keys, ``order`` (total in a group), ``delta`` and ``payload``. Groups are cut
    into chunks of ``chunk_rows``, so none is held as a whole.
    """
    keys = list(keys)
    of = F.struct(F.col(order).alias("at"), F.col("delta").cast("int").alias("delta"), *payload)
    placed = ordered(marks, keys, [order], **scan).running_sum(F.lit(1), "_nth").result()
    chunks = placed.groupBy(*keys, F.floor((F.col("_nth") - 1) / chunk_rows).alias("c")).agg(
        F.sort_array(F.collect_list(of)).alias("run"))
    none = F.slice("run", 1, 0)
    chunks = materialise(chunks.withColumn("short", _reduced(F.col("run"), none, fits)))

    # up: groups of neighbouring chunks, until every key has one
    levels, top = [], chunks.select(*keys, "c", "short")
    while not top.where("c > 0").isEmpty():
        parts = top.groupBy(*keys, F.floor(F.col("c") / fan).alias("c")).agg(
            F.sort_array(F.collect_list(F.struct("c", "short"))).alias("parts"))
        parts = materialise(parts.withColumn("run", F.flatten(F.transform("parts", lambda p: p["short"]))).withColumn(
            "short", _reduced(F.col("run"), none, fits)).drop("run"))
        levels.append(parts)
        top = parts.select(*keys, "c", "short")

    # down: what is open before each group, then before each of its parts
    before = top.select(*keys, "c", F.slice("short", 1, 0).alias("open"))
    for parts in reversed(levels):
        def enter(acc: Column, p: Column) -> Column:
            return F.struct(
                F.aggregate(p["short"], acc["stack"], lambda s, r: _after(s, r, fits)).alias("stack"),
                F.concat(acc["seen"], F.array(F.struct(p["c"].alias("c"), acc["stack"].alias("open")))).alias("seen"))

        inside = parts.join(before, [*keys, "c"]).withColumn("_none", F.slice(F.array(F.struct("c", "open")), 1, 0))
        before = inside.select(*keys, F.explode(F.aggregate(
            "parts", F.struct(F.col("open").alias("stack"), F.col("_none").alias("seen")), enter,
            lambda acc: acc["seen"])).alias("b")).select(*keys, "b.c", "b.open")

    def judge(acc: Column, r: Column) -> Column:
        wrong = (r["delta"] < 0) & (F.size(acc["stack"]) > 0) & ~_pops(acc["stack"], r, fits)
        return F.struct(_after(acc["stack"], r, fits).alias("stack"),
                        F.when(wrong, F.concat(acc["wrong"], F.array(r["at"]))).otherwise(acc["wrong"]).alias("wrong"))

    nothing = F.slice(F.transform("run", lambda r: r["at"]), 1, 0)
    return chunks.join(before, [*keys, "c"]).withColumn("_none", nothing).select(*keys, F.explode(F.aggregate(
        "run", F.struct(F.col("open").alias("stack"), F.col("_none").alias("wrong")), judge,
        lambda acc: acc["wrong"])).alias(order))
