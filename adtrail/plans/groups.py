"""Ordered operations on groups of any size.

A window over a key puts the whole group into one task. Here a group that is larger than a fair
share of the data is first cut into consecutive chunks by a range partitioning on (key, order);
each chunk is scanned on its own, and one summary row per chunk carries the state across. Groups
of ordinary size take the plain window. The result is the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adtrail.plans.cut import materialise

CHUNK = "_chunk"
MIN_HOT_ROWS = 1_000_000


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order`` (a total order inside the group)."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    def _with(self, df: DataFrame) -> "OrderedGroups":
        return OrderedGroups(df, self.keys, self.order, self.split)

    def _window(self, within):
        return Window.partitionBy(*self.keys, CHUNK, *within).orderBy(*self.order)

    def _at(self) -> Column:
        return F.struct(*self.order)

    def with_columns(self, cols: dict[str, Column]) -> "OrderedGroups":
        return self._with(self.df.withColumns(cols))

    def where(self, condition) -> "OrderedGroups":
        return self._with(self.df.where(condition))

    def _carry(self, agg: Column, carried: Column, within: Sequence[str], forward=True):
        """One row per chunk with ``_in``: ``carried`` over the chunks before (or after) it."""
        keys = [*self.keys, *within]
        chunks = self.df.groupBy(*keys, CHUNK).agg(agg.alias("_of"))
        order = F.col(CHUNK).asc() if forward else F.col(CHUNK).desc()
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1)
        carried_in = chunks.withColumn("_in", carried.over(w)).drop("_of")
        renamed = carried_in.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                    F.col(CHUNK).alias("_kc"), "_in")
        on = F.col(CHUNK) == F.col("_kc")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        joined = self.df.join(renamed, on, "left")
        return joined.drop(*[f"_k{i}" for i in range(len(keys))], "_kc")

    def last(self, value: Column, out: str, within: Sequence[str] = (),
             before: bool = False) -> "OrderedGroups":
        """Latest non-NULL ``value`` up to the row, or strictly ``before`` it."""
        frame = self._window(within).rowsBetween(Window.unboundedPreceding,
                                                 -1 if before else Window.currentRow)
        if not self.split:
            return self._with(self.df.withColumn(
                out, F.last(value, ignorenulls=True).over(frame)))
        tagged = self._with(self.df.withColumn("_v", value))
        latest = F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), self._at()))
        df = tagged._carry(latest, F.last("_of", ignorenulls=True), within)
        local = F.last("_v", ignorenulls=True).over(frame)
        return self._with(df.withColumn("_l", local).withColumn(
            out, F.coalesce("_l", "_in")).drop("_l", "_in", "_v"))

    def next(self, value: Column, out: str, within: Sequence[str] = ()) -> "OrderedGroups":
        """Earliest non-NULL ``value`` strictly after the row."""
        frame = self._window(within).rowsBetween(1, Window.unboundedFollowing)
        if not self.split:
            return self._with(self.df.withColumn(
                out, F.first(value, ignorenulls=True).over(frame)))
        tagged = self._with(self.df.withColumn("_v", value))
        earliest = F.min_by(F.col("_v"), F.when(F.col("_v").isNotNull(), self._at()))
        df = tagged._carry(earliest, F.last("_of", ignorenulls=True), within, forward=False)
        local = F.first("_v", ignorenulls=True).over(frame)
        return self._with(df.withColumn("_l", local).withColumn(
            out, F.coalesce("_l", "_in")).drop("_l", "_in", "_v"))

    def previous_row(self, value: Column, out: str) -> "OrderedGroups":
        """``value`` of the row directly before, wrapped in a struct (NULL on the first row)."""
        return self.last(F.struct(value.alias("v")), out, before=True)

    def running_sum(self, value: Column, out: str) -> "OrderedGroups":
        frame = self._window(()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.split:
            return self._with(self.df.withColumn(out, F.sum(value).over(frame)))
        tagged = self._with(self.df.withColumn("_v", value))
        df = tagged._carry(F.sum("_v"), F.sum("_of"), ())
        return self._with(df.withColumn("_l", F.sum("_v").over(frame)).withColumn(
            out, F.coalesce(F.col("_l") + F.col("_in"), "_l", "_in")).drop("_l", "_in", "_v"))

    def running_min(self, value: Column, out: str, before: bool = False) -> "OrderedGroups":
        frame = self._window(()).rowsBetween(Window.unboundedPreceding,
                                             -1 if before else Window.currentRow)
        if not self.split:
            return self._with(self.df.withColumn(out, F.min(value).over(frame)))
        tagged = self._with(self.df.withColumn("_v", value))
        df = tagged._carry(F.min("_v"), F.min("_of"), ())
        return self._with(df.withColumn("_l", F.min("_v").over(frame)).withColumn(
            out, F.least("_l", "_in")).drop("_l", "_in", "_v"))

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)


def may_be_hot(df: DataFrame, keys: Sequence[str], min_hot_rows: int = MIN_HOT_ROWS) -> bool:
    """Whether some group has more than ``min_hot_rows`` rows. If none has, subsets of the rows and
    finer keys have none either, and `ordered` need not count them again (``hot=False``)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not sizes.where(F.col("n") > min_hot_rows).isEmpty()


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            min_hot_rows: int = MIN_HOT_ROWS, hot: bool | None = None) -> OrderedGroups:
    """Prepare ordered scans; cuts groups larger than a fair share of the rows, which are looked for
    unless ``hot`` is known to be false."""
    keys, order = list(keys), list(order)
    if hot is False:
        return OrderedGroups(df.withColumn(CHUNK, F.lit(0)), keys, order, False)
    width = shuffle_width(df)
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("total"), F.max("n").alias("biggest")).first()
    fair = max(min_hot_rows, (top["total"] or 0) // (2 * width))
    if (top["biggest"] or 0) <= fair:
        return OrderedGroups(df.withColumn(CHUNK, F.lit(0)), keys, order, False)
    pieces = max(width, -(-top["total"] // fair))
    cut = df.repartitionByRange(pieces, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return OrderedGroups(materialise(cut), keys, order, True)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key. Spark prunes each map task to one row per key before the shuffle."""
    return top_per(df, keys, order, 1)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
            rank: str | None = None) -> DataFrame:
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def number_rows(df: DataFrame, order: Sequence, out: str, start: int = 0) -> DataFrame:
    """Dense row numbers over a total order, without a single-task window.

    The sorted rows are written with their partition number and their place in it; the offsets
    are one row per partition, so broadcasting them is bounded by the partition count.
    """
    placed = materialise(
        df.orderBy(*order).withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (placed.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_at") + start)
            .drop("_pid", "_at", "_off"))
