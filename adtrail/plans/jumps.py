"""Walks along ``n -> to`` links by jump tables.

The k-th table leads 2**k links on and comes from the one before by joining it with itself, so walks of
any length take as many rounds as the length has binary digits. Rows that have come to an end are in
no table: nothing is joined on NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adtrail.plans.cut import materialise


def _further(table: DataFrame) -> DataFrame:
    """The table that leads twice as far."""
    on = table.select(F.col("n").alias("to"), F.col("to").alias("_to"))
    return materialise(table.hint("merge").join(on.hint("merge"), "to").select("n", F.col("_to").alias("to")))


def _tables(links: DataFrame, steps: int | None) -> tuple[list[DataFrame], bool]:
    """Jump tables ``(n, to)`` for walks of up to ``steps`` links, or until all have ended; then also
    whether some go round in a ring. That is so when a table leads on from as many nodes, to as many
    nodes, as the one before: all that go on then go on for ever, and all nodes reached are in rings."""
    tables, table, before = [], materialise(links.select("n", "to").where("to is not null")), None
    while True:
        if steps is None:
            size = tuple(table.agg(F.count(F.lit(1)), F.count_distinct("to")).first())
            if size[0] == 0:
                return tables, False
            if size == before:
                return tables, True
            before = size
        tables.append(table)
        if steps is not None and 1 << len(tables) > steps:
            return tables, False
        table = _further(table)


def _depths(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(n, depth, end)``: nodes up to and including the end of each node's walk; no rings."""
    state = nodes.select("n").join(links, "n", "left").select(
        "n", F.col("to").alias("at"), F.lit(1).cast("long").alias("depth"), F.col("n").alias("end"))
    state = materialise(state)
    while not state.where("at is not null").isEmpty():
        far = state.select(F.col("n").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_d"),
                           F.col("end").alias("_end"))
        moved = state.where("at is not null").join(far, "at").select(
            "n", F.col("_at").alias("at"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_end").alias("end"))
        state = materialise(state.where("at is null").unionByName(moved))
    return state.drop("at")


def _lengths(nodes: DataFrame, links: DataFrame, far: DataFrame, rings: bool) -> DataFrame:
    """``(n, length)``: nodes of each walk; one that runs into a ring goes once round it and shows
    its first node again. ``far`` holds the jump table beyond which only rings go on."""
    if not rings:
        return _depths(nodes, links).select("n", F.col("depth").alias("length"))
    ring = materialise(far.select(F.col("to").alias("n")).distinct())
    open_ = materialise(links.where("to is not null").join(ring, "n", "left_anti"))
    depths = _depths(nodes, open_)
    # rings are labelled by their smallest node, again by doubling
    around = materialise(links.join(ring, "n").select("n", F.col("to").alias("at"), F.least("n", "to").alias("low")))
    total = F.sum(F.col("low").cast("decimal(38,0)"))
    known, before = around.agg(total).first()[0], None
    # the smallest node of ever longer stretches, until none changes any more
    while known != before:
        on = around.select(F.col("n").alias("at"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        around = materialise(around.join(on, "at").select(
            "n", F.col("_at").alias("at"), F.least("low", "_low").alias("low")))
        known, before = around.agg(total).first()[0], known
    sizes = around.groupBy("low").agg(F.count(F.lit(1)).alias("_ring"))
    turns = around.join(sizes, "low").select(F.col("n").alias("end"), "_ring")
    return depths.join(turns, "end", "left").select(
        "n", (F.col("depth") + F.coalesce("_ring", F.lit(0))).alias("length"))


def walks(starts: DataFrame, links: DataFrame, steps: int | None = None) -> DataFrame:
    """``(walk, n, pos)``: every node of each walk from ``starts(walk, n)``, pos from 0.

    ``links(n, to)`` has one row per node, with NULL at an end. A walk has at most ``steps`` nodes;
    without a limit it goes to its end, or once round a ring and one node on.
    """
    links = links.select("n", "to")
    tables, rings = _tables(links, steps)
    if steps is not None:
        rows = starts.select("walk", "n").withColumn("length", F.lit(steps).cast("long"))
    else:
        reach = _lengths(links, links, tables[-1], rings) if tables else None
        one = F.lit(1).cast("long")
        rows = starts.select("walk", "n").withColumn("length", one) if reach is None else starts.select(
            "walk", "n").join(reach, "n", "left").withColumn("length", F.coalesce("length", one))
    rows = materialise(rows.select("walk", "n", F.lit(0).cast("long").alias("pos"), "length"))
    if steps is None and tables:
        # only tables that lead less far than the longest walk
        longest = rows.agg(F.max("length")).first()[0] or 0
        while 1 << len(tables) < longest:
            tables.append(_further(tables[-1]))
        tables = [t for k, t in enumerate(tables) if 1 << k < longest]
    for k, table in reversed(list(enumerate(tables))):
        here = F.struct("walk", "n", "pos", "length")
        leapt = F.struct("walk", F.col("to").alias("n"), (F.col("pos") + (1 << k)).alias("pos"), "length")
        goes = F.col("to").isNotNull() & (F.col("pos") + (1 << k) < F.col("length"))
        # a table is not broadcast: they are as many as the length has digits, all of them at once
        rows = rows.hint("merge").join(table.hint("merge"), "n", "left").select(F.inline(
            F.when(goes, F.array(here, leapt)).otherwise(F.array(here))))
    return rows.select("walk", "n", "pos")
