"""Seed lists and crawl job lists."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from adtrail import fixed
from adtrail.plans.groups import number_rows


def popularity_ranks(seeds: DataFrame) -> DataFrame:
    """Best rank of each domain over all lists."""
    return seeds.groupBy("domain").agg(F.min("rank").alias("rank"))


def split_vantage(seeds: DataFrame, residential: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(domain, rank) seeds of the residential lists, and those of the other lists only."""
    mine = F.col("list").isin(*residential)
    res = seeds.where(mine).select("domain", "rank").distinct()
    return res, seeds.where(~mine).select("domain", "rank").subtract(res)


def by_rank(seeds: DataFrame) -> DataFrame:
    return seeds.orderBy("rank", "domain")


def job_matrix(urls: DataFrame, agents: Sequence[str], repeat: int = 1,
               url: str = "url") -> DataFrame:
    """Every URL with every agent, ``repeat`` times: ``(agent, url, attempt)``.

    Agents are a handful of names, so the product is an explode of each row, not a join.
    """
    return urls.select(
        F.explode(F.array(*[F.lit(a) for a in agents])).alias("agent"), F.col(url).alias("url")
    ).select("agent", "url", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("attempt"))


def blocks(df: DataFrame, order_by: Sequence[str], size: int = fixed.BLOCK_SIZE) -> DataFrame:
    """Consecutive blocks of ``size`` rows in the given order: adds ``block``."""
    return number_rows(df, order_by, "_pos").withColumn(
        "block", F.floor(F.col("_pos") / size)).drop("_pos")


def shuffle_in_blocks(jobs: DataFrame, key: str = "job", seed: int = 0) -> DataFrame:
    """Order jobs by block and, inside a block, by a repeatable shuffle."""
    return jobs.withColumn("_s", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))).orderBy(
        "block", "_s", key).drop("_s")


def top_k(df: DataFrame, order_by: Sequence, k: int) -> DataFrame:
    return df.orderBy(*order_by).limit(k)


def sample_k(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` distinct values, picked repeatably."""
    return df.select(key).distinct().orderBy(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def minus(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_anti")


def publisher_coverage(res: DataFrame, non_res: DataFrame) -> DataFrame:
    """Publishers per vantage point and in all, and the mean session time of each row."""
    both = res.select("domain", "total_time", F.lit(True).alias("_res")).unionByName(
        non_res.select("domain", "total_time", F.lit(False).alias("_res")))
    per = both.groupBy("domain").agg(
        F.max("_res").alias("r"), F.max(~F.col("_res")).alias("n"),
        F.sum("total_time").alias("t"), F.count("total_time").alias("c"))
    return per.agg(F.count_if("r").alias("residential"), F.count_if("n").alias("non_residential"),
                   F.count(F.lit(1)).alias("publishers"),
                   (F.sum("t") / F.sum("c")).alias("mean_time"))
