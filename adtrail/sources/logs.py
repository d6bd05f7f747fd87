"""Scans of session logs and browser event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from adtrail import fixed
from adtrail.functions.cols import let
from adtrail.plans.cut import materialise


def log_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session logs as ``(log_id, line_no, line)``, lines numbered from 1 in each file.

    Files are split like any text input. A line's number is its place in its block plus the
    lines of the blocks before it in the file, which needs one row per block.
    """
    lines = materialise(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line")))
    blocks = lines.groupBy("_file", "_block").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    return lines.join(offsets, ["_file", "_block"]).select(
        log_name(F.col("_file")).alias("log_id"),
        (F.col("_at") + F.col("_add")).alias("line_no"), "line")


_SPACE = " \t\r\n"


def _key_value(text: Column) -> Column:
    at = F.instr(text, "=")
    return F.struct(F.trim(F.substring(text, F.lit(1), at - 1)).alias("key"),
                    F.trim(F.substring(text, at + 1, F.length(text)), F.lit(_SPACE))
                    .alias("value"))


def _last_wins(pairs: Column) -> Column:
    """Map of key/value structs in which a repeated key keeps its last value."""
    def build(p: Column) -> Column:
        n = F.size(p)
        unique = F.size(F.array_distinct(F.transform(p, lambda x: x["key"]))) == n
        kept = F.filter(p, lambda x, i: ~F.exists(
            F.slice(p, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
        return F.map_from_entries(F.when(unique, p).otherwise(kept))

    return let(pairs, build)


def _named_values(lines: Column, name: str, value: str, unquote: bool) -> Column:
    """Fold ``<name>=k`` / ``<value>=v`` lines into key/value structs."""
    def text(x: Column) -> Column:
        return F.trim(x, F.lit('"')) if unquote else x

    def build(some: Column) -> Column:
        # the pending name is the last one above the value
        paired = F.transform(some, lambda x, i: F.struct(
            text(F.try_element_at(F.filter(F.slice(some, F.lit(1), i), lambda y: y["key"] == name),
                                  F.lit(-1))["value"]).alias("key"),
            text(x["value"]).alias("value"), x["key"].alias("kind")))
        return F.transform(F.filter(paired, lambda x: x["kind"] == value),
                           lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))

    return let(F.filter(lines, lambda x: x["key"].isin(name, value)), build)


def _record(parts: Column) -> Column:
    """Header, maps and flags of one record, given its header line and ``key=value`` texts."""
    def is_multi(x: Column) -> Column:
        return x["key"].isin(*fixed.MULTI_LINE_FIELDS)

    def build(raw: Column) -> Column:
        lines = F.transform(raw, lambda x: F.struct(
            x["key"].alias("key"),
            F.when(is_multi(x), x["value"]).otherwise(
                F.trim(F.substring_index(x["value"], "\n", 1), F.lit(_SPACE))).alias("value")))
        spilled = F.exists(raw, lambda x: ~is_multi(x) & x["value"].contains("\n"))
        return let(lines, lambda ls: let(
            F.filter(ls, lambda x: ~x["key"].isin(*_PAIRED)), lambda plain: F.struct(
                _last_wins(plain).alias("fields"),
                _last_wins(_named_values(ls, "arg_name", "arg_value", False)).alias("args"),
                _last_wins(_named_values(ls, "attr_name", "attr_value", True)).alias("attrs"),
                ls.alias("lines"), (spilled | (F.size(plain) == 0)).alias("malformed"))))

    return let(F.transform(F.filter(F.slice(parts, 2, 1 << 30), lambda x: x.contains("=")),
                           _key_value), build)


_PAIRED = ("arg_name", "arg_value", "attr_name", "attr_value")
_CUT = {"v2": r"\r?\n  -\*#\$", "v1": r"\r?\n  "}


def parse_records(df: DataFrame, text: str = "value", dialect: str = "v2") -> DataFrame:
    """Turn record text into ``header, fields, args, attrs, lines, malformed``.

    A record is a header line and ``key=value`` lines. ``code`` may span lines; ``arg_name`` /
    ``arg_value`` and ``attr_name`` / ``attr_value`` lines pair up into maps; a line without
    ``=`` is ignored and a repeated key keeps its last value. ``malformed`` marks records with a
    continuation line elsewhere, or without any ordinary field, which the pipeline rejects.
    """
    start = F.instr(text, fixed.RECORD_START)
    body = F.substring(F.col(text), start, F.length(text))
    others = [c for c in df.columns if c != text]
    parts = df.where(start > 0).select(*others, F.split(body, _CUT[dialect]).alias("_p"))
    parsed = parts.select(*others, F.trim(F.substring_index(F.col("_p")[0], "\n", 1),
                                          F.lit(_SPACE)).alias("header"),
                          _record(F.col("_p")).alias("_r"))
    return parsed.select(*others, "header", "_r.*")


def read_event_log(spark: SparkSession, path: str, dialect: str = "v2") -> DataFrame:
    """Browser event logs as one row per record, in file order (``seq``).

    The scan splits at the record separator, so one huge log is read by many tasks. ``seq`` is
    the number of the file block and the place of the record in it: increasing along the file,
    and known without a pass over the data.
    """
    separator = {"v2": fixed.RECORD_END, "v1": "\n" + fixed.OLD_RECORD_END}[dialect]
    raw = spark.read.option("lineSep", separator).text(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftright(F.col("_metadata.file_block_start"), 20)
    numbered = raw.select(
        log_name(F.col("_metadata.file_path")).alias("log_id"),
        F.shiftleft(block, 33).bitwiseOR(place).alias("seq"), "value")
    return parse_records(numbered, "value", dialect)


def event_columns(records: DataFrame) -> DataFrame:
    """The columns that edges are derived from; malformed records are left out, since their fields
    cannot be trusted, and the rest of their log is kept."""
    return records.where(~F.coalesce("malformed", F.lit(False))).select("log_id", "seq", "header", "fields", "args", "attrs")
