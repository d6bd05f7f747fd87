"""Scans and sinks of ads, job lists, job results, dictionaries, seeds and files."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from adtrail import fixed, schemas
from adtrail.functions import urls
from adtrail.functions.bits import dhash
from adtrail.functions.fields import parse_rank
from adtrail.plans.groups import first_per, number_rows
from adtrail.sources.logs import log_name

#: Starts the second part of a public-suffix list (fixed value).
PRIVATE_SUFFIXES = "// ===BEGIN PRIVATE DOMAINS==="


# --- ads -----------------------------------------------------------------------------------
def _hop(entry: Column) -> Column:
    """``[[frame, kind, value], reason]`` as JSON text to a flat struct."""
    pair = F.from_json(entry, "array<string>")
    item = F.from_json(pair[0], "array<string>")
    payload = F.try_element_at(item, F.lit(3))
    two = F.when(payload.startswith("[") & item[1].isin("event_listener", "scheduled_action"),
                 F.from_json(payload, "array<string>"))
    return F.struct(
        item[0].alias("frame_id"), item[1].alias("kind"),
        F.coalesce(F.try_element_at(two, F.lit(1)), payload).alias("value"),
        F.try_element_at(two, F.lit(2)).alias("value2"), pair[1].alias("reason"))


def parse_ads(lines: DataFrame, text: str = "value") -> DataFrame:
    """Ad objects from JSON lines; other columns of ``lines`` are kept."""
    body = F.from_json(
        F.col(text),
        "log_id string, screenshot string, screenshot_hash string, "
        f"{fixed.AD_LOG_FIELD} string, redirections array<string>, home_url string, ad_url string")
    others = [c for c in lines.columns if c != text]
    return lines.select(*others, body.alias("a")).select(
        "a.log_id", "a.screenshot", "a.screenshot_hash",
        F.col(f"a.{fixed.AD_LOG_FIELD}").alias("event_log"),
        F.transform("a.redirections", _hop).alias("redirections"),
        "a.home_url", "a.ad_url", *others)


def read_ads(spark: SparkSession, path: str) -> DataFrame:
    """Ad objects of every file in a folder, with their file and place in it."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftright(F.col("_metadata.file_block_start"), 20)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("src_file"),
        F.shiftleft(block, 33).bitwiseOR(place).alias("line_no"))
    return parse_ads(lines.where(F.trim("value") != ""))


def ad_json(ads: DataFrame) -> DataFrame:
    """Ads as JSON lines in the form `read_ads` takes."""
    def text(c: Column) -> Column:
        return F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))

    def quoted(c: Column) -> Column:
        return F.regexp_replace(text(c), r"(?s)^\[|\]$", "")

    def hop(h: Column) -> Column:
        payload = F.when(h["value2"].isNotNull(), F.to_json(F.array(h["value"], h["value2"]))
                         ).otherwise(quoted(h["value"]))
        return F.concat(F.lit("[["), quoted(h["frame_id"]), F.lit(", "), quoted(h["kind"]),
                        F.lit(", "), payload, F.lit("], "), quoted(h["reason"]), F.lit("]"))

    chain = F.concat(F.lit("["), F.array_join(F.transform(
        F.coalesce("redirections", F.array()), hop), ", "), F.lit("]"))
    parts = [F.concat(F.lit(f'"{name}": '), quoted(F.col(col))) for name, col in (
        ("log_id", "log_id"), ("screenshot", "screenshot"),
        ("screenshot_hash", "screenshot_hash"), (fixed.AD_LOG_FIELD, "event_log"),
        ("home_url", "home_url"), ("ad_url", "ad_url"))]
    parts.append(F.concat(F.lit('"redirections": '), chain))
    return ads.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))


def write_ads(ads: DataFrame, path: str) -> None:
    ad_json(ads).write.text(path)


# --- seeds, jobs, results ------------------------------------------------------------------
def parse_seeds(lines: DataFrame, text: str = "value") -> DataFrame:
    """``domain;rank`` lines as ``(domain, rank)``, each pair once per ``list`` if present."""
    cut = F.split(F.trim(text), ";")
    extra = [c for c in lines.columns if c != text]
    return lines.where(F.col(text).contains(";")).select(
        cut[0].alias("domain"), parse_rank(cut[1]).alias("rank"), *extra).distinct()


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return parse_seeds(spark.read.text(path).select(
        "value", log_name(F.col("_metadata.file_path")).alias("list")))


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """Rules of a published public-suffix list as ``(rule)``: a line's text up to the first white
    space, comments left out. The list is one small file; its private section counts on request.
    Rules with letters outside ASCII are given in their ``xn--`` form too, as hosts write them.
    """
    whole = F.col("value") if private else F.split("value", PRIVATE_SUFFIXES)[0]
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(whole, r"\r?\n")).alias("line"))
    rules = lines.select(F.regexp_extract("line", r"^\s*(\S*)", 1).alias("rule")).where(
        (F.col("rule") != "") & ~F.col("rule").startswith("//"))
    return rules.mapInPandas(_both_forms, "rule string")


def _both_forms(batches):
    def ascii_form(rule: str) -> str:
        return ".".join(x if x.isascii() else x.encode("idna").decode() for x in rule.split("."))

    for df in batches:
        coded = df["rule"].map(ascii_form)
        yield df
        yield coded[coded != df["rule"]].to_frame()


def read_job_list(spark: SparkSession, path: str) -> DataFrame:
    """Domains (second field) of ``agent:domain`` lines, each once."""
    return job_domains(spark.read.text(path))


def job_domains(lines: DataFrame, text: str = "value") -> DataFrame:
    return lines.where(F.col(text).contains(":")).select(
        F.trim(F.split(text, ":")[1]).alias("domain")).distinct()


def read_job_results(spark: SparkSession, path: str,
                     schema: str = schemas.CRAWL_RESULTS) -> DataFrame:
    """Job results (JSON lines); the text fields that hold numbers are cast."""
    df = spark.read.schema(schema).json(path)
    casts = {"total_time": "double", "tabs_opened": "int", "ads_opened": "int"}
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items() if c in df.columns})


def append_results(df: DataFrame, path: str, partition: str | None = "ip_type") -> None:
    """Append results, one folder per vantage point."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).json(path)


# --- dictionaries --------------------------------------------------------------------------
def parse_dict(lines: DataFrame, value_type: str, text: str = "value") -> DataFrame:
    """One-line JSON dictionaries as ``(key, value)`` rows; list values are exploded."""
    rows = lines.where(F.trim(text) != "").select(
        F.explode(F.from_json(text, f"map<string,{value_type}>")).alias("key", "value"))
    if value_type.startswith("array<"):
        return rows.select("key", F.explode("value").alias("value"))
    return rows


def read_dict(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    return parse_dict(spark.read.text(path), value_type)


def write_dict(df: DataFrame, key: str, value: str, path: str) -> None:
    """Tidy Parquet: a dictionary is a table of keys and values."""
    df.select(F.col(key).alias("key"), F.col(value).alias("value")).write.parquet(path)


def dict_json(df: DataFrame, key: str, value: str, per_line: int = 1000) -> DataFrame:
    """Dictionary of value sets as JSON lines ``{"key": [values]}``.

    A key with more than about ``per_line`` values is spread over several lines, so no line and
    no task holds a whole large group; `parse_dict` puts them together again.
    """
    pairs = df.select(F.col(key).cast("string").alias("k"), F.col(value).alias("v")).distinct()
    sizes = pairs.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / per_line).alias("lines"))
    parts = pairs.join(sizes, "k").withColumn("part", F.pmod(F.xxhash64("v"), F.col("lines")))
    return parts.groupBy("k", "part").agg(F.array_sort(F.collect_list("v")).alias("v")).select(
        F.to_json(F.map_from_arrays(F.array("k"), F.array("v"))).alias("value"))


def read_table(spark: SparkSession, name: str, folder: str | None = None,
               jdbc: dict | None = None) -> DataFrame:
    """A reputation table: Parquet in ``folder``, a catalog table, or a JDBC table."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc, dbtable=name).load()
    return spark.read.parquet(f"{folder}/{name}") if folder else spark.table(name)


def write_table(df: DataFrame, name: str, folder: str | None = None, jdbc: dict | None = None,
                mode: str = "overwrite") -> None:
    if jdbc:
        df.write.format("jdbc").options(**jdbc, dbtable=name).mode(mode).save()
    elif folder:
        df.write.mode(mode).parquet(f"{folder}/{name}")
    else:
        df.write.mode(mode).saveAsTable(name)


# --- binary files --------------------------------------------------------------------------
def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded files as ``(file_hash, name, length)``, one row per content."""
    files = spark.read.format("binaryFile").load(path)
    hashed = files.select(F.sha2("content", 256).alias("file_hash"),
                          F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")
    return first_per(hashed, ["file_hash"], ["name"])


def quiet_files(spark: SparkSession, path: str, age_s: int = fixed.QUIET_SECONDS,
                now=None) -> DataFrame:
    """Files that have not changed for ``age_s`` seconds: ``(path, modified, length)``."""
    files = spark.read.format("binaryFile").load(path).select(
        "path", F.col("modificationTime").alias("modified"), "length")
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return files.where(F.unix_micros(clock) - F.unix_micros("modified") > age_s * 1_000_000)


def _shrink(data: bytes, width: int, height: int, channels: int, side: int) -> list[float]:
    """Area means of the grey image (ITU-R 601 weights, BGR byte order) on a side x side grid."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    grey = pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ [0.114, 0.587, 0.299]
    ys, xs = (np.arange(side + 1) * n // side for n in (height, width))
    return [float(grey[ys[r]:max(ys[r + 1], ys[r] + 1), xs[c]:max(xs[c + 1], xs[c] + 1)].mean())
            for r in range(side) for c in range(side)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def grey_grid(data: pd.Series, width: pd.Series, height: pd.Series,
              channels: pd.Series) -> pd.Series:
    """9x9 grey grid of decoded images, one Arrow batch at a time."""
    return pd.Series([_shrink(*row, 9) for row in zip(data, width, height, channels)])


def read_screenshots(spark: SparkSession, path: str) -> DataFrame:
    """Screenshots as ``(screenshot, screenshot_hash)``.

    Decoded by Spark's image source and shrunk by area means, so a bit may differ from hashes
    made with another resampling filter.
    """
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    grids = img.select(F.regexp_extract("origin", r"([^/]*)$", 1).alias("screenshot"),
                       grey_grid("data", "width", "height", "nChannels").alias("grid"))
    return grids.select("screenshot", dhash("grid").alias("screenshot_hash"))


# --- splits --------------------------------------------------------------------------------
def split_round_robin(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Deal rows over ``n`` part files in turn: adds ``part``."""
    return number_rows(df, order_by, "_pos").withColumn(
        "part", (F.col("_pos") % n).cast("int")).drop("_pos")


def write_parts(df: DataFrame, path: str) -> None:
    df.write.partitionBy("part").text(path)
