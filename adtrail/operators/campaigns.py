"""Campaign, category and popularity statistics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from adtrail import fixed
from adtrail.functions import urls
from adtrail.operators.domains import with_domains
from adtrail.plans.cut import materialise


def lookup(df: DataFrame, dim: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Inner lookup and the number of rows that miss: ``(rows, misses)``."""
    marked = dim.withColumn("_found", F.lit(True))
    joined = df.join(marked, on, "left")
    hits = joined.where("_found").drop("_found")
    misses = joined.agg(F.count_if(F.col("_found").isNull()).alias("misses"))
    return hits, misses


def with_seed(ads: DataFrame, session_seed: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Add the publisher (seed) host of each ad's session."""
    return ads.join(session_seed.select(log_id, urls.fqdn("seed_url").alias("seed_domain")), log_id)


def listed(df: DataFrame, threat_list: DataFrame, domain: str) -> DataFrame:
    """``df`` plus ``listed``: the domain is on the threat list."""
    names = threat_list.select(F.col(threat_list.columns[0]).alias("_d")).distinct()
    return df.join(names, F.trim(F.col(domain)) == F.col("_d"), "left").withColumn(
        "listed", F.col("_d").isNotNull()).drop("_d")


def ad_summaries(ads: DataFrame, rules: DataFrame, hash_col: str = "screenshot_hash") -> DataFrame:
    """Per hash: ads, landing hosts, home domains and seed domains.

    ``ads`` needs ``ad_url``, ``home_url`` and ``seed_domain``; ``rules`` are public-suffix rules.
    """
    return with_domains(ads, {"_home": "home_url"}, rules).groupBy(hash_col).agg(
        F.count(F.lit(1)).alias("ads"),
        F.count_distinct(urls.fqdn("ad_url")).alias("landing_hosts"),
        F.count_distinct("_home").alias("home_domains"),
        F.count_distinct("seed_domain").alias("seed_domains"))


def summary_members(ads: DataFrame, hash_col: str = "screenshot_hash",
                    rules: DataFrame | None = None) -> DataFrame:
    """The sets behind `ad_summaries`, one row per distinct (hash, kind, value); home domains only
    if there are suffix rules to find them by."""
    if rules is not None:
        ads = with_domains(ads, {"_home": "home_url"}, rules)
    kinds = {"landing": urls.fqdn("ad_url"), "seed": F.col("seed_domain")} | (
        {"home": F.col("_home")} if rules is not None else {})
    members = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"))
                                  for k, v in kinds.items()]))
    return ads.select(hash_col, members.alias("m")).select(hash_col, "m.kind", "m.value").distinct()


def campaign_table(members: DataFrame, campaign_map: DataFrame, all_ads: DataFrame,
                   threat_list: DataFrame, hash_col: str = "screenshot_hash") -> DataFrame:
    """Attacks, landing domains, clusters, flagged clusters and publishers per category.

    ``members``: label, hash, ``ad_url``, ``seed_domain``. ``all_ads``: every ad, with the same
    columns, from which the per-hash sets are taken. A hash counts once, for the smallest
    (category, label) that holds it; a member whose hash no ad carries counts by itself. The last
    row, ``total``, counts landing domains and publishers over all categories at once.
    """
    mine = members.join(campaign_map, "label").select(
        "category", "label", hash_col, urls.fqdn("ad_url").alias("landing"), "seed_domain")
    # renamed, so that both inputs may come from the same table
    per_hash = all_ads.groupBy(F.col(hash_col).alias("_hash")).agg(
        F.count(F.lit(1)).alias("ads"))
    tagged = materialise(mine.join(per_hash, F.col(hash_col) == F.col("_hash"), "left").drop("_hash"))
    owner = tagged.where("ads is not null").groupBy(hash_col).agg(
        F.min(F.struct("category", "label")).alias("o"), F.first("ads").alias("ads")).select(
        hash_col, "o.category", "o.label", "ads")
    alone = tagged.where("ads is null")

    attacks = owner.select("category", F.col("ads").alias("n")).unionByName(
        alone.select("category", F.lit(1).cast("long").alias("n")))
    sets = summary_members(all_ads, hash_col).withColumnRenamed(hash_col, "_hash")
    owned = materialise(owner.join(sets, F.col(hash_col) == F.col("_hash")).drop("_hash"))
    landing = owned.where("kind = 'landing'").select(
        "category", "label", F.col("value").alias("landing")).unionByName(
        alone.select("category", "label", "landing")).distinct()
    publishers = owned.where("kind = 'seed'").select("category", "value").distinct()
    all_publishers = publishers.select("value").unionByName(
        alone.select(F.col("seed_domain").alias("value")))
    # a landing page without host counts as one, but is not looked up
    flagged = listed(landing.where(F.col("landing") != ""), threat_list, "landing").where("listed").select(
        "category", "label").distinct()

    def per(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("category").agg(F.count(F.lit(1)).alias(name))

    table = (campaign_map.groupBy("category").agg(F.count_distinct("label").alias("clusters"))
             .join(attacks.groupBy("category").agg(F.sum("n").alias("attacks")), "category", "left")
             .join(per(landing.select("category", "landing").distinct(), "landing_domains"),
                   "category", "left")
             .join(per(flagged, "flagged_clusters"), "category", "left")
             .join(per(publishers, "publishers"), "category", "left")
             .na.fill(0))
    cols = ["category", "attacks", "landing_domains", "clusters", "flagged_clusters", "publishers"]
    sums = table.agg(F.sum("attacks").alias("attacks"), F.sum("clusters").alias("clusters"),
                     F.sum("flagged_clusters").alias("flagged_clusters"))
    total = sums.withColumns({
        "category": F.lit("total"),
        "landing_domains": landing.agg(F.count_distinct("landing")).scalar(),
        "publishers": all_publishers.agg(F.count_distinct("value")).scalar()})
    return table.select(*cols).unionByName(total.select(*cols))


def category_names(df: DataFrame) -> DataFrame:
    """``(domain, names)`` of looked-up categories; the last line of a domain wins.

    ``df``: domain, category ``array<struct<name>>``, ``line_no``.
    """
    return df.groupBy("domain").agg(F.max_by("category", "line_no").alias("c")).select(
        "domain", F.transform("c", lambda x: x["name"]).alias("names"))


def categorised(df: DataFrame) -> DataFrame:
    """Domains whose lookup gave at least one category."""
    return df.where(F.size("category") > 0)


def category_share(publishers: DataFrame, categories: DataFrame, domain: str = "domain",
                   top: int | None = 20, ignore: str = "Uncategorized") -> DataFrame:
    """Publishers and percentage per category, largest first.

    ``categories``: (domain, name), one row per category of a domain.
    """
    counts = publishers.select(domain).join(categories, domain).where(
        F.col("name") != ignore).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    share = counts.select(
        "name", "n", F.round(F.col("n") * 100.0 / total, 2).alias("percent"))
    ranked = share.orderBy(F.desc("n"), "name")
    return ranked.limit(top) if top else ranked


def popularity_tiers(publishers: DataFrame, ranks: DataFrame, domain: str = "domain",
                     tiers: Sequence[int] = fixed.POPULARITY_TIERS) -> DataFrame:
    """Ranked publishers below each tier (cumulative), and the publishers without a rank.

    One aggregation over the data; the tiers are columns of it until the last step.
    """
    joined = publishers.select(domain).join(ranks.select(domain, "rank"), domain, "left")
    counted = joined.agg(
        *[F.count_if(F.col("rank") < t).alias(f"t{i}") for i, t in enumerate(tiers)],
        F.count_if(F.col("rank").isNull()).alias("unranked"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("tier"), F.col(f"t{i}").alias("publishers"))
        for i, t in enumerate(tiers)]))
    return counted.select(rows.alias("r"), "unranked").select("r.tier", "r.publishers", "unranked")


def rank_lists(publishers: DataFrame, attempted: DataFrame, ranks: DataFrame,
               domain: str = "domain") -> DataFrame:
    """Ranks of the ad publishers and of all attempted sites: ``(list, rank)`` for plotting."""
    r = ranks.select(domain, "rank")
    return publishers.select(domain).join(r, domain).select(
        F.lit("se_ad_pub_rank_list").alias("list"), "rank").unionByName(
        attempted.select(domain).join(r, domain).select(
            F.lit("all_pub_rank_list").alias("list"), "rank"))


def curation_gaps(members: DataFrame, campaign_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cluster labels that no category lists, and the cluster totals."""
    labels = members.select("label").distinct()
    mapped = campaign_map.select("label").distinct()
    missing = labels.join(mapped, "label", "left_anti")
    n = F.count(F.lit(1))
    counts = labels.agg(n.alias("clusters")).withColumns({
        "mapped": mapped.agg(n).scalar(), "missing": missing.agg(n).scalar()})
    return missing, counts
