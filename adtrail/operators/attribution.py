"""Which ad network served an ad, and how many of its ads are malicious."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adtrail import fixed
from adtrail.functions import urls
from adtrail.functions.cols import Col
from adtrail.plans.groups import top_per


def is_hex_triplet_path(path: Column) -> Column:
    """``/ab/cd/ef/abcdef….js`` of 45 characters: the directories repeat the file's start."""
    return path.rlike(r"^/([^/]{2})/([^/]{2})/([^/]{2})/\1\2\3[^/]{26}\.js$")


def network_rules(url: Col) -> list[tuple[str, Column]]:
    """Ordered (network, condition) rules; the first that holds names the network."""
    at, path, query = urls.netloc(url), urls.url_path(url), urls.url_query(url)
    script = path.endswith(".js")
    click = path == "/apu.php"
    return [
        ("RevenueHits", ((path == "/adServe/banners") & query.startswith("tid="))
         | (path.startswith("/banners/script/ui_tag_") & script)
         | (path.startswith("/script/rhpop_") & script)),
        ("PopCash", at.endswith(".popcash.net")),
        ("AdCash", (path == "/prod/redirect.html") & (query != "")),
        ("PopAds", at.endswith(".popads.net")),
        ("PopMyAds", at == "popmyads.com"),
        ("AdSterra", is_hex_triplet_path(path)),
        ("HilltopAds", (at == "hilltopads.net")
         | ((path == "/out") & query.startswith("vt="))),
        ("Clicksor", at.endswith(".clicksor.net")),
        ("AdMaven", at.endswith(".cloudfront.net") & query.rlike("^[a-z]{5}=[0-9]{6}$")),
        ("Propeller", click & at.isin(*fixed.PROPELLER_HOSTS)),
        ("Clickadu", click & at.isin(*fixed.CLICKADU_HOSTS)),
    ]


def network_of(url: Col, rules=network_rules) -> Column:
    """Network of one URL, NULL when no rule holds. ``rules(url)`` may be replaced."""
    out = None
    for name, holds in rules(url):
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def identify_network(ads: DataFrame, chain: str = "redirections", rules=network_rules) -> DataFrame:
    """Add ``network`` and ``network_host``: the matching URL nearest to the publisher decides.

    Chains run from the landing page back to the publisher, so the last match wins.
    """
    named = F.transform(
        F.filter(F.col(chain), lambda n: n["kind"] == "URL"),
        lambda n: F.struct(network_of(n["value"], rules).alias("network"),
                           urls.netloc(n["value"]).alias("network_host")))
    hit = F.try_element_at(F.filter(named, lambda x: x["network"].isNotNull()), F.lit(-1))
    return ads.withColumn("_hit", hit).withColumns({
        "network": F.coalesce("_hit.network", F.lit("Unknown")),
        "network_host": F.col("_hit.network_host"),
    }).drop("_hit")


def malicious_hashes(*members: DataFrame, hash_col: str = "screenshot_hash") -> tuple:
    """``(distinct hashes, counts)`` over the members of all vantage points."""
    rows = members[0].select(hash_col)
    for m in members[1:]:
        rows = rows.unionByName(m.select(hash_col))
    counts = rows.agg(F.count_distinct(hash_col).alias("hashes"), F.count(F.lit(1)).alias("ads"))
    return rows.distinct(), counts


def flag_malicious(ads: DataFrame, hashes: DataFrame,
                   hash_col: str = "screenshot_hash") -> DataFrame:
    """``ads`` plus ``malicious``: the hash is one of the known malicious ones."""
    known = hashes.select(hash_col).distinct().withColumn("_bad", F.lit(True))
    return ads.join(known, hash_col, "left").withColumn(
        "malicious", F.col("_bad").isNotNull()).drop("_bad")


def network_counts(ads: DataFrame, hashes: DataFrame, hash_col: str = "screenshot_hash",
                   names: Sequence[str] = fixed.NETWORKS) -> DataFrame:
    """Ads and malicious ads per network, every name listed, and a ``total`` row."""
    per = ads.groupBy("network", hash_col).agg(F.count(F.lit(1)).alias("n"))
    flagged = flag_malicious(per, hashes, hash_col)
    counts = flagged.groupBy("network").agg(
        F.sum("n").alias("ads"),
        F.sum(F.when(F.col("malicious"), F.col("n")).otherwise(0)).alias("malicious_ads"))
    all_names = ads.sparkSession.createDataFrame([(n,) for n in names], "network string")
    filled = all_names.join(counts, "network", "left").select(
        "network", F.coalesce("ads", F.lit(0)).alias("ads"),
        F.coalesce("malicious_ads", F.lit(0)).alias("malicious_ads"))
    total = filled.agg(F.lit("total").alias("network"), F.sum("ads").alias("ads"),
                       F.sum("malicious_ads").alias("malicious_ads"))
    return filled.unionByName(total)


def network_hosts(ads: DataFrame, sample: int = 10) -> DataFrame:
    """Distinct serving hosts per network, and the first ``sample`` of them."""
    hosts = ads.where(F.col("network") != "Unknown").select("network", "network_host").distinct()
    counts = hosts.groupBy("network").agg(F.count(F.lit(1)).alias("hosts"))
    some = top_per(hosts, ["network"], ["network_host"], sample).groupBy("network").agg(
        F.array_sort(F.collect_list("network_host")).alias("sample"))
    return counts.join(some, "network")
