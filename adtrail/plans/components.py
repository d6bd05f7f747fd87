"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from adtrail.plans.cut import materialise


def components(nodes: DataFrame, neighbour_min: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes(id)`` to ``(id, label)`` with the smallest id of each component as label.

    ``neighbour_min(labels)`` returns ``(id, near)``, the smallest label among the neighbours of
    each node. It aggregates before it shuffles, so the adjacency itself need not be stored.
    """
    state = nodes.select("id", F.col("id").alias("label"))
    first = True
    while True:
        # pointer jump (nothing to jump over at first), then hook to the smallest neighbour
        up = state.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = state.withColumn("up", F.col("label")) if first else state.join(up, "label")
        labels = jumped.select("id", F.col("up").alias("label"))
        hooked = jumped.join(neighbour_min(labels), "id", "left").select(
            "id", F.col("label").alias("old"), F.least("up", F.coalesce("near", "up")).alias("label"))
        hooked = materialise(hooked)
        state, first = hooked.select("id", "label"), False
        if hooked.where(F.col("old") != F.col("label")).isEmpty():
            return state


def roots(links: DataFrame, keys: list[str], child: str, parent: str) -> DataFrame:
    """Follow ``child -> parent`` links to the top by pointer doubling.

    A node that is its own parent, or that has no row as a child, is a root. Nodes on a cycle, and
    those that lead into it, get its smallest node id: after enough doublings to have gone all the way
    round, ``top`` is on the cycle, and what it has passed is the cycle.
    """
    cols = [*keys, F.col(child).alias("node"), F.col(parent).alias("top")]
    # one parent per child: the caller resolves repeats; self-links end the walk
    current = materialise(links.select(*cols).where(F.col(child) != F.col(parent)).withColumn(
        "low", F.least("node", "top")))
    longest = max(current.count(), 1)
    reach = 1
    while True:
        up = current.select(*keys, F.col("node").alias("top"), F.col("top").alias("_top"),
                            F.col("low").alias("_low"))
        step = current.join(up, [*keys, "top"], "left")
        moved = materialise(step.select(
            *keys, "node", F.coalesce("_top", "top").alias("top"),
            F.least("low", "_low").alias("low"), F.col("_top").isNotNull().alias("_moved")))
        current = moved.drop("_moved")
        reach *= 2
        if moved.where("_moved").isEmpty():
            return current.select(*keys, F.col("node").alias(child), F.col("top").alias("root"))
        if reach > 2 * longest:
            rings = moved.select(*keys, F.col("node").alias("top"), F.col("low").alias("_ring"))
            return moved.join(rings, [*keys, "top"], "left").select(
                *keys, F.col("node").alias(child),
                F.when(F.col("_moved"), F.col("_ring")).otherwise(F.col("top")).alias("root"))
