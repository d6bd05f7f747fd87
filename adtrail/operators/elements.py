"""Ranking of clickable page elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adtrail import fixed
from adtrail.functions.fields import element_area, round_down
from adtrail.plans.cut import materialise
from adtrail.plans.groups import top_per

PREFIX = 1000
_KEPT = "array<struct<elem_id:bigint,mid_x:double,mid_y:double,h:double,w:double>>"


def rank_elements(elements: DataFrame, k: int = fixed.MAX_ELEMENTS,
                  pref_area: float = fixed.PREFERRED_AREA) -> DataFrame:
    """The ``k`` best click candidates of each page: adds ``position`` (from 1)."""
    marked = elements.withColumn("_large", _large(pref_area)).withColumn(
        "_area", element_area("h", "w"))
    return top_per(marked, ["page_id"], [F.desc("_large"), F.desc("_area"), "elem_id"], k,
                   rank="position").drop("_large", "_area")


def _large(pref_area: float) -> Column:
    return F.coalesce(F.col("preferred") & (element_area("h", "w") > pref_area), F.lit(False))


def _conflicts(kept: Column, e, cell: int, max_same_y: int) -> Column:
    """``e`` repeats a kept size or cell, or its height on the page is used up."""
    same_size = F.exists(kept, lambda x: (x["w"] == e("w")) & (x["h"] == e("h")))
    same_cell = F.exists(kept, lambda x: (
        round_down(x["mid_x"], cell) == round_down(e("mid_x"), cell)) & (
        round_down(x["mid_y"], cell) == round_down(e("mid_y"), cell)))
    same_y = F.size(F.filter(kept, lambda x: x["mid_y"] == e("mid_y")))
    return same_size | same_cell | (same_y >= max_same_y)


def diverse_elements(elements: DataFrame, k: int = fixed.MAX_ELEMENTS,
                     pref_area: float = fixed.PREFERRED_AREA, cell: int = fixed.CELL_PIXELS,
                     max_same_y: int = fixed.MAX_SAME_Y, prefix: int = PREFIX) -> DataFrame:
    """Greedy choice of up to ``k`` spread-out elements per page: ``(page_id, position, elem_id,
    ...)``.

    Elements are taken in rank order; one is skipped if a kept one has its size or its cell, or
    if ``max_same_y`` kept ones share its y. An element equal to an earlier one in size, cell and
    y can never be kept, so such copies go first, by aggregation. The rest is folded in bounded
    runs of ``prefix`` elements per page; pages that are still short of ``k`` continue with the
    elements that do not conflict with the ones kept so far.
    """
    facts = elements.withColumns({
        "_rank": F.struct((~_large(pref_area)).alias("a"),
                          (-element_area("h", "w")).alias("b"), F.col("elem_id").alias("c")),
        "_cx": round_down("mid_x", cell), "_cy": round_down("mid_y", cell)})
    left = facts.groupBy("page_id", "w", "h", "_cx", "_cy", "mid_y").agg(
        F.min(F.struct("_rank", "mid_x")).alias("m")).select(
        "page_id", F.col("m._rank").alias("_rank"), F.col("m._rank.c").alias("elem_id"),
        F.col("m.mid_x").alias("mid_x"), "mid_y", "h", "w")

    def fold(run: Column, kept: Column) -> Column:
        def step(acc, e):
            item = F.array(F.struct(e["elem_id"].alias("elem_id"), e["mid_x"].alias("mid_x"),
                                    e["mid_y"].alias("mid_y"), e["h"].alias("h"),
                                    e["w"].alias("w")))
            clash = _conflicts(acc, lambda n: e[n], cell, max_same_y)
            return F.when((F.size(acc) >= k) | clash, acc).otherwise(F.concat(acc, item))
        return F.aggregate(run, kept, step)

    left = materialise(left)
    longest = left.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    kept = None
    while True:
        run = top_per(left, ["page_id"], ["_rank"], prefix).groupBy("page_id").agg(
            F.array_sort(F.collect_list(F.struct("_rank", "elem_id", "mid_x", "mid_y", "h", "w")))
            .alias("run"))
        if kept is None:
            now = run.select("page_id", fold(F.col("run"), F.array().cast(_KEPT)).alias("kept"))
        else:
            now = kept.join(run, "page_id", "left").select("page_id", F.when(
                F.col("run").isNull(), F.col("kept")).otherwise(
                fold(F.col("run"), F.col("kept"))).alias("kept"))
        if (longest or 0) <= prefix:
            break
        kept = materialise(now)
        done = run.select("page_id", F.element_at("run", -1)["_rank"].alias("_seen"))
        open_ = kept.where(F.size("kept") < k).join(done, "page_id")
        left = materialise(left.join(open_, "page_id").where(
            (F.col("_rank") > F.col("_seen"))
            & ~_conflicts(F.col("kept"), lambda n: F.col(n), cell, max_same_y)
        ).drop("kept", "_seen"))
        now = kept
        if left.isEmpty():
            break
        longest = prefix + 1
    return now.select("page_id", F.posexplode("kept").alias("position", "e")).select(
        "page_id", (F.col("position") + 1).alias("position"), "e.*")
