"""Structured Streaming forms of the stateful loops."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from adtrail import fixed
from adtrail.operators.records import tagged_lines
from adtrail.operators.reputation import retry_set, unpack_verdicts, verdict_aggregates
from adtrail.plans.cut import scratch_path


def first_seen_stream(stream: DataFrame, keys: Sequence[str], ts: str | None = None,
                      watermark: str | None = None) -> DataFrame:
    """Each key once, when it first arrives.

    Without a watermark every key is remembered for ever. With one, state is dropped after that
    time and a key that returns later is reported again.
    """
    if watermark is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def first_seen_files(stream: DataFrame, files: str = "file_hashes") -> DataFrame:
    """Each downloaded file hash once."""
    return stream.select(F.explode(files).alias("file_hash")).dropDuplicates(["file_hash"])


def ingest_results(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Results that carry every required field, stamped with the time of receipt."""
    complete = None
    for c in required:
        term = F.col(c).isNotNull()
        complete = term if complete is None else complete & term
    return rows.where(complete).withColumn("received_at", F.current_timestamp())


def read_result_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def observe_stream(stream: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Running sightings, first and last time per key (update or complete mode)."""
    return stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"))


def verdict_stream(stream: DataFrame, keys: Sequence[str] = ("domain",), ts: str = "query_time",
                   result: str = "result") -> DataFrame:
    """Verdict state kept by plain aggregates: nothing after the first positive answer counts."""
    return stream.groupBy(*keys).agg(*verdict_aggregates(ts, result, freeze=True))


def insert_absent_stream(stream: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """First time per key (update or complete mode)."""
    return stream.groupBy(*keys).agg(F.min(ts).alias("first_seen"))


def closed_sessions(stream: DataFrame, key: str = "log_id", ts: str = "ts",
                    gap: str = f"{fixed.QUIET_SECONDS} seconds",
                    late: str = "0 seconds") -> DataFrame:
    """Sessions that have been quiet for ``gap``: ``(key, started, quiet_at, lines)``."""
    return stream.withWatermark(ts, late).groupBy(
        F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("lines")).select(
        key, F.col("s.start").alias("started"), F.col("s.end").alias("quiet_at"), "lines")


def tagged_stream(lines: DataFrame, tag: str = fixed.ALERT_TAG) -> DataFrame:
    return tagged_lines(lines, tag)


def retry_batches(stream: DataFrame, answered: Callable[[], DataFrame], key: str,
                  handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Per micro-batch, hand on the keys that have no answer yet."""

    def each(batch: DataFrame, number: int) -> None:
        handle(retry_set(batch, answered(), key), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def unanswered_stream(seen: DataFrame, answers: DataFrame, key: str, wait: str,
                      seen_at: str = "seen_at", answered_at: str = "answered_at",
                      late: str = "0 seconds") -> DataFrame:
    """Rows of ``seen`` that get no answer within ``wait``: an outer join of two streams.

    Both sides are kept for as long as a partner may still come; once the watermark of both has
    passed ``seen_at + wait``, a row without one is emitted and its state dropped. Rows without a
    key never get an answer.
    """
    asked = seen.withWatermark(seen_at, late)
    found = answers.select(F.col(key).alias("_key"), F.col(answered_at).alias("_at")).withWatermark("_at", late)
    on = (F.col(key) == F.col("_key")) & (F.col("_at") >= F.col(seen_at)) & (
        F.col("_at") <= F.col(seen_at) + F.expr(f"interval {wait}"))
    return asked.join(found, on, "left_outer").where(F.col("_at").isNull()).drop("_key", "_at")


def run_available(stream: DataFrame, mode: str = "append", finish: Callable | None = None,
                  partition: str | None = None) -> DataFrame:
    """Run a stream over what is available now and return its result as a table.

    Appended rows go to Parquet as they come; in complete mode each batch replaces the table of
    the batch before, so the last one stands. ``finish`` shapes each result.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark), scratch_path(spark)
    shape = finish or (lambda df: df)
    if mode == "append":
        rows = shape(stream)
        writer = rows.writeStream.format("parquet").option("path", out)
        if partition:
            writer = writer.partitionBy(partition)
        query = writer.outputMode("append").option("checkpointLocation", state).trigger(
            availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(rows.schema).parquet(out)
    # a batch may be run again after a failure: it then writes the same folder again
    last = {}

    def replace(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        last["n"] = number

    query = stream.writeStream.foreachBatch(replace).outputMode(mode).option(
        "checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if "n" not in last:
        return spark.createDataFrame([], shape(stream).schema)
    return spark.read.parquet(f"{out}/batch={last['n']}")


def run_updates(stream: DataFrame, keys: Sequence[str], finish: Callable | None = None,
                folder: str | None = None) -> DataFrame:
    """Run a keyed aggregation over what is available now and return its state as a table.

    The state store holds one row per key, and each batch writes only the keys that it changed, into
    a folder of its own, which a batch that is run again replaces. The newest row of a key stands.
    ``finish`` shapes each batch and must keep the keys.
    """
    spark = stream.sparkSession
    out, state = folder or scratch_path(spark), scratch_path(spark)
    shape = finish or (lambda df: df)

    def upsert(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", state).trigger(
        availableNow=True).start().awaitTermination()
    schema = shape(spark.createDataFrame([], stream.schema)).schema
    rows = spark.read.schema(schema.add("batch", "long")).parquet(out)
    return newest_rows(rows, keys, "batch")


def newest_rows(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version per key, without the version."""
    others = [c for c in rows.columns if c not in keys and c != version]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(F.lit(0).alias("_"), *others), version).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others]).select(
        *[c for c in rows.columns if c != version])
