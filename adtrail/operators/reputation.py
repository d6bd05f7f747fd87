"""First/last-seen tables, verdict state and detection lag."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adtrail import fixed
from adtrail.functions import urls
from adtrail.functions.fields import ipv4_answers, verdict_flags
from adtrail.operators.domains import with_domains
from adtrail.plans.cut import materialise
from adtrail.plans.select import nth_smallest


def split_observations(observations: DataFrame) -> DataFrame:
    """Add ``domain`` and ``url_path`` to observations ``(ts, url, campaign, class)``."""
    return observations.withColumns({"domain": urls.netloc("url"), "url_path": urls.url_path("url")})


def url_counts(observations: DataFrame, keys: Sequence[str] = ("domain", "url_path", "campaign"),
               ts: str = "ts") -> DataFrame:
    """Per key: sightings, the latest full URL and the first class."""
    return observations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.max_by("url", ts).alias("url"),
        F.min_by("class", ts).alias("class"))


def seen_spans(observations: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last sighting per (domain, campaign)."""
    return observations.groupBy("domain", "campaign").agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def campaigns_seen(observations: DataFrame, ts: str = "ts") -> DataFrame:
    return observations.groupBy("campaign").agg(F.max(ts).alias("last_seen"))


def domain_slds(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Each domain once, with its registrable domain."""
    return with_domains(observations.select("domain").distinct(), {"sld": "domain"}, rules).select(
        "sld", "domain")


def verdict_aggregates(ts: str = "query_time", result: str = "result",
                       freeze: bool = True) -> list[Column]:
    """First and last verdict of a domain as plain aggregates, for batch and streams alike.

    With ``freeze`` a domain is no longer asked once it is flagged, so later answers do not
    count and ``last_query_time`` is the moment of the first positive answer.
    """
    v, at = verdict_flags(result), F.col(ts)
    first_hit = F.min(F.when(v["flag"], at))
    hit = F.min_by(v, F.when(v["flag"], at))
    newest_at, newest = F.max(at), F.max_by(v, at)
    last_at = F.coalesce(first_hit, newest_at) if freeze else newest_at
    last = F.coalesce(hit, newest) if freeze else newest
    return [F.min(at).alias("first_query_time"), F.min_by(v, at).alias("_first"),
            last_at.alias("last_query_time"), last.alias("_last")]


def unpack_verdicts(state: DataFrame) -> DataFrame:
    out = state
    for which in ("first", "last"):
        for f in ("flag", "se_flag"):
            out = out.withColumn(f"{which}_{f}", F.col(f"_{which}.{f}"))
        out = out.withColumn(f"{which}_result", F.col(f"_{which}.text"))
    return out.drop("_first", "_last")


def verdict_state(verdict_log: DataFrame, keys: Sequence[str] = ("domain",),
                  ts: str = "query_time", result: str = "result",
                  freeze: bool = True) -> DataFrame:
    """Verdict table recomputed from an append-only log of answers."""
    return unpack_verdicts(verdict_log.groupBy(*keys).agg(*verdict_aggregates(ts, result, freeze)))


def verdict_table(domains: DataFrame, verdict_log: DataFrame, **kw) -> DataFrame:
    """Every known domain ``(domain, first_seen)`` with its verdicts, NULL while unasked."""
    return domains.join(verdict_state(verdict_log, **kw), "domain", "left")


def queryable(verdicts: DataFrame, flag: str = "last_flag") -> DataFrame:
    """Domains to ask again: never flagged so far, or never asked."""
    return verdicts.where(F.expr(f"{flag} is not true"))


def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """SQL ``NOT IN``: one NULL in ``other`` empties the result.

    A plain anti join keeps the work spread out; the NULL rule is one small aggregate.
    """
    n = other.agg(F.count(F.lit(1))).scalar()
    nulls = other.agg(F.count_if(F.col(other_col).isNull())).scalar()
    keys = other.select(F.col(other_col).alias(col)).distinct()
    left = df.join(keys, col, "left_anti")
    return left.where((nulls == 0) & (F.col(col).isNotNull() | (n == 0)))


def first_seen(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first_seen"))


def ip_rows(answers: DataFrame) -> DataFrame:
    """Address lookups ``(domain, answer, ts)`` as first-seen ``(ip, domain, first_seen)``."""
    rows = answers.select("domain", "ts", F.explode(ipv4_answers("answer")).alias("ip"))
    return first_seen(rows, ["ip", "domain"])


def reported(df: DataFrame) -> DataFrame:
    """Files with a scan report."""
    return df.where(F.col("positives") > -1)


def unqueried(df: DataFrame, column: str = "query_time") -> DataFrame:
    return df.where(F.col(column).isNull())


def retry_set(seen: DataFrame, answered: DataFrame, key: str = "file_hash") -> DataFrame:
    """Files seen that have no report yet."""
    return seen.select(key).distinct().join(answered.select(key), key, "left_anti")


def latest_by_key(df: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """Merged dictionary: the last value per key."""
    return df.groupBy(key).agg(F.max_by(value, ts).alias(value))


def detected_per_campaign(domains_seen: DataFrame, slds: DataFrame, verdicts: DataFrame,
                          flag: str | None = "last_flag", like: str | None = None) -> DataFrame:
    """Verdict domains per campaign, optionally only flagged ones or matching campaigns."""
    v = verdicts.where(F.col(flag)) if flag else verdicts
    seen = domains_seen.where(F.col("campaign").like(like)) if like else domains_seen
    pairs = seen.select("campaign", "domain").join(slds.select("domain", "sld"), "domain").select(
        "campaign", "sld").distinct()
    hits = pairs.join(v.select(F.col("domain").alias("sld")), "sld", "left_semi")
    return hits.groupBy("campaign").agg(F.count(F.lit(1)).alias("detected"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count(F.lit(1)).alias("domains"),
                        F.count_if("first_flag").alias("flagged_at_first"))


def detection_lag(verdicts: DataFrame) -> DataFrame:
    """Lag of domains that were clean at first and flagged later, longest first."""
    return verdicts.where("first_flag is false and last_flag is true").select(
        "domain", (F.col("last_query_time") - F.col("first_query_time")).alias("lag")
    ).orderBy(F.desc("lag"), "domain")


def detection_lag_stats(verdicts: DataFrame) -> DataFrame:
    """Mean and discrete median lag in seconds. The median is selected by range counts, so no task
    holds or sorts all lags."""
    lag = materialise(verdicts.where("first_flag is false and last_flag is true").select(
        (F.unix_micros("last_query_time") - F.unix_micros("first_query_time")).alias("us")).where("us is not null"))
    median = nth_smallest(lag, "us", -(-lag.count() // 2))
    return lag.agg(
        F.count(F.lit(1)).alias("domains"),
        (F.sum("us") / F.count("us") / 1e6).alias("mean_seconds")).withColumn(
        "median_seconds", F.lit(median).cast("long") / 1e6)
