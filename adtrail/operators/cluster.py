"""Campaign discovery: near-duplicate clusters of landing-page hashes."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adtrail import fixed
from adtrail.functions import bits, urls
from adtrail.plans.components import components
from adtrail.plans.cut import materialise
from adtrail.plans.groups import first_per, number_rows
from adtrail.plans.similarity import bit_order, candidate_pairs, near_known, near_pairs

DENSE_PAIRS_PER_HASH = 64


def with_lanes(df: DataFrame, hash_col: str) -> DataFrame:
    return df.withColumns({"hi": bits.lane(hash_col, 0), "lo": bits.lane(hash_col, 1)})


def first_ads(ads: DataFrame, domain: str = "domain", hash_col: str = "screenshot_hash",
              order_by: Sequence[str] = ("log_id", "src_file", "line_no")) -> DataFrame:
    """First ad of each (domain, hash), in input order."""
    return first_per(ads, [domain, hash_col], order_by)


def dense_ids(df: DataFrame, key: str, order_by: Sequence[str], out: str = "id") -> DataFrame:
    """``(key, out)``: consecutive integers in order of first appearance of the key."""
    at = F.min(F.struct(*order_by)).alias("_first")
    return number_rows(df.groupBy(key).agg(at), ["_first", key], out).drop("_first")


def exact_clusters(ads: DataFrame, domain: str = "domain", hash_col: str = "screenshot_hash",
                   order_by: Sequence[str] = ("log_id", "src_file", "line_no"),
                   min_images: int = 2) -> DataFrame:
    """Groups of equal hashes over one (the last) image per landing domain."""
    last = first_per(ads, [domain], [F.col(c).desc() for c in order_by])
    return last.groupBy(hash_col).agg(F.count(F.lit(1)).alias("images")).where(
        F.col("images") >= min_images)


def exact_domain_clusters(ads: DataFrame, domain: str = "domain",
                          hash_col: str = "screenshot_hash",
                          min_domains: int = fixed.MIN_CLUSTER_DOMAINS) -> DataFrame:
    """Equal hashes that were seen on at least ``min_domains`` landing domains."""
    return (ads.select(hash_col, domain).distinct()
            .groupBy(hash_col).agg(F.count(F.lit(1)).alias("domains"))
            .where(F.col("domains") >= min_domains))


def similar_pairs(df: DataFrame, hash_col: str, max_bits: int) -> DataFrame:
    """Pairs of distinct hashes within ``max_bits``: ``(hash_a, hash_b, bits)``, a < b."""
    points = materialise(with_lanes(df.select(hash_col).distinct(), hash_col))
    pairs = near_pairs(points, None, max_bits)
    a, b = F.col(f"a_{hash_col}"), F.col(f"b_{hash_col}")
    return pairs.select(F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b"), "bits")


def nearest_known(df: DataFrame, known: DataFrame, hash_col: str, max_bits: int) -> DataFrame:
    """Nearest known hash of each distinct hash of ``df`` within ``max_bits`` (0 = equal).

    Returns ``(hash_col, known, bits)``. Equal hashes are settled by an equi-join and never enter
    the banded join; ties go to the smaller known hash.
    """
    mine = df.select(hash_col).where(F.col(hash_col).isNotNull()).distinct()
    theirs = known.select(F.col(hash_col).alias("known")).where(
        F.col("known").isNotNull()).distinct()
    # one pass finds the exact matches and leaves the others
    flagged = materialise(mine.join(
        theirs.withColumn("_hit", F.lit(True)), F.col(hash_col) == F.col("known"), "left"
    ).select(hash_col, F.col("_hit").isNotNull().alias("_hit")))
    rest = materialise(with_lanes(flagged.where(~F.col("_hit")).select(hash_col), hash_col))
    targets = materialise(with_lanes(theirs, "known"))
    near = near_known(rest, targets, max_bits).groupBy(F.col(f"a_{hash_col}").alias(hash_col)).agg(
        F.min(F.struct(F.col("bits"), F.col("b_known").alias("known"))).alias("m"))
    exact = flagged.where("_hit").select(
        hash_col, F.col(hash_col).alias("known"), F.lit(0).alias("bits"))
    return exact.unionByName(near.select(hash_col, "m.known", "m.bits"))


def similar_to(df: DataFrame, known: DataFrame, hash_col: str,
               max_bits: int = fixed.SIMILAR_BITS) -> DataFrame:
    """Rows of ``df`` whose hash is within ``max_bits`` of any known hash."""
    hits = nearest_known(df, known, hash_col, max_bits).select(hash_col)
    return df.join(hits, hash_col, "left_semi")


def dbscan(df: DataFrame, hash_col: str = "screenshot_hash",
           order_by: Sequence[str] = ("log_id", "src_file", "line_no"),
           max_bits: int = fixed.CLUSTER_BITS, min_samples: int = fixed.MIN_SAMPLES,
           other_group: str | None = None, count_self: bool = True,
           dense_pairs_per_hash: int = DENSE_PAIRS_PER_HASH) -> DataFrame:
    """Density clusters of hashes: ``df`` plus ``label`` (-1 = noise) and ``is_core``.

    Rows with equal hashes are collapsed first and only counted, so copies cost nothing. With
    ``other_group`` (a column such as the domain) rows of the same group are never neighbours.
    Labels are numbered by the first core row of each cluster; a border row takes the smallest
    label among its core neighbours.
    """
    group = other_group or "_all"
    base = df.where(F.col(hash_col).isNotNull())
    base = base if other_group else base.withColumn("_all", F.lit(0))
    per = base.groupBy(hash_col, group).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order_by)).alias("_first"))
    if other_group:
        per = materialise(per)
        hashes = per.groupBy(hash_col).agg(F.sum("n").alias("n"), F.min("_first").alias("_first"))
    else:
        hashes = per.drop(group)
    points = with_lanes(number_rows(hashes, ["_first"], "id"), hash_col).drop("_first")
    if not other_group:
        per = points.select(hash_col, F.lit(0).alias(group), "n")

    # --- who is a core row: neighbours counted with their copies ---------------------------
    slim = points.select("id", "n", "hi", "lo")
    order = bit_order(slim)
    size, candidates = candidate_pairs(slim, max_bits, order)
    bound = dense_pairs_per_hash * size
    pairs = near_pairs(slim, None, max_bits, candidates=candidates, order=order).select(
        "a_id", "a_n", "b_id", "b_n")

    def both_ways(p: DataFrame) -> DataFrame:
        return p.select(F.explode(F.array(
            F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("nbr"),
                     F.col("b_n").alias("n")),
            F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("nbr"),
                     F.col("a_n").alias("n")))).alias("e")).select("e.*")

    def degrees(both: DataFrame) -> DataFrame:
        return both.groupBy("id").agg(F.sum("n").alias("around"),
                                      F.count(F.lit(1)).alias("links"))

    # pairs are stored when they are few: known at once from the shared bands, or else from the
    # degrees; a dense neighbourhood is joined anew each time instead of being written out
    around = None
    dense = candidates > bound
    if dense:
        around = materialise(degrees(both_ways(pairs)))
        dense = (around.agg(F.sum("links")).first()[0] or 0) > bound
    pairs = pairs if dense else materialise(pairs)
    both = both_ways(pairs)
    around = degrees(both) if around is None else around
    edges = both.select("id", "nbr")

    ids = points.select(hash_col, "id", F.col("n").alias("copies"))
    rows = per.join(ids, hash_col).join(around.select("id", "around"), "id", "left")
    total = F.col("copies") + F.coalesce("around", F.lit(0))
    if other_group:
        sizes = rows.select("id", group, "n")
        own = edges.join(sizes.select(F.col("id").alias("nbr"), group, "n"), "nbr").groupBy(
            "id", group).agg(F.sum("n").alias("own"))
        rows = rows.join(own, ["id", group], "left")
        degree = total - F.col("n") - F.coalesce("own", F.lit(0)) + (1 if count_self else 0)
    else:
        degree = total if count_self else total - 1
    cores = materialise(rows.select(hash_col, "id", group, (degree >= min_samples).alias("is_core")))

    # --- clusters of core rows ------------------------------------------------------------
    # a hash with core rows in two groups is joined to every core neighbour; with one group it
    # is joined to those that have a core row of another group (always, without other_group)
    lone = F.when((F.count_distinct(group) == 1) & F.lit(other_group is not None),
                  F.min(group).cast("string"))
    nodes = cores.where("is_core").groupBy("id").agg(lone.alias("lone"))

    def reachable(a: str, b: str) -> Column:
        return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) != F.col(b))

    if dense:
        lanes = points.select("id", "hi", "lo")

        def neighbour_min(labels: DataFrame) -> DataFrame:
            marked = materialise(lanes.join(nodes, "id").join(labels, "id"))
            near = near_pairs(marked, None, max_bits, candidates=candidates, order=order).where(
                (F.col("a_label") != F.col("b_label")) & reachable("a_lone", "b_lone"))
            return near.select(F.explode(F.array(
                F.struct(F.col("a_id").alias("id"), F.col("b_label").alias("label")),
                F.struct(F.col("b_id").alias("id"), F.col("a_label").alias("label")),
            )).alias("e")).groupBy("e.id").agg(F.min("e.label").alias("near"))
    else:
        core_edges = materialise(
            edges.join(nodes, "id").join(
                nodes.select(F.col("id").alias("nbr"), F.col("lone").alias("lone_b")), "nbr")
            .where(reachable("lone", "lone_b")).select("id", "nbr"))

        def neighbour_min(labels: DataFrame) -> DataFrame:
            return core_edges.join(
                labels.select(F.col("id").alias("nbr"), "label"), "nbr").groupBy("id").agg(
                F.min("label").alias("near"))

    found = components(nodes, neighbour_min)
    numbers = number_rows(found.select(F.col("label").alias("root")).distinct(), ["root"], "label")
    labelled = found.select("id", F.col("label").alias("root")).join(numbers, "root").join(
        nodes, "id").select("id", "label", "lone")

    # --- border rows ----------------------------------------------------------------------
    rim = cores.where(~F.col("is_core"))
    mates = rim.join(edges, "id").select(
        hash_col, group, F.col("nbr").alias("at")).unionByName(
        rim.select(hash_col, group, F.col("id").alias("at")))
    border = mates.join(labelled.withColumnRenamed("id", "at"), "at").where(
        F.col("lone").isNull() | (F.col("lone") != F.col(group).cast("string"))
    ).groupBy(hash_col, group).agg(F.min("label").alias("label"))
    core_labels = cores.where("is_core").join(labelled.select("id", "label"), "id").select(
        hash_col, group, "label")
    verdict = cores.join(core_labels.unionByName(border), [hash_col, group], "left").select(
        hash_col, group, F.coalesce("label", F.lit(-1)).cast("long").alias("label"), "is_core")
    # a row without a hash (or group) is near nothing: noise
    on = [hash_col, group] if other_group else [hash_col]
    out = df.join(verdict if other_group else verdict.drop("_all"), on, "left")
    return out.withColumn("label", F.coalesce("label", F.lit(-1).cast("long"))).withColumn(
        "is_core", F.coalesce("is_core", F.lit(False)))


def cluster_profile(members: DataFrame, domain: str = "domain",
                    url: str = "ad_url") -> DataFrame:
    """Size, distinct domains, core fraction and image URLs of each cluster."""
    return members.where(F.col("label") >= 0).groupBy("label").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct(domain).alias("domains"),
        F.count_if("is_core").alias("cores"),
        F.count_if(urls.is_image_url(url)).alias("images"),
    ).withColumn("core_fraction", F.col("cores") / F.col("size"))


def prune_clusters(members: DataFrame, domain: str = "domain", url: str = "ad_url",
                   order_by: Sequence[str] = ("log_id", "src_file", "line_no"),
                   min_domains: int = fixed.MIN_CLUSTER_DOMAINS,
                   min_core: float = fixed.MIN_CORE_FRACTION) -> DataFrame:
    """Clusters worth keeping, with one member (the first) per landing domain."""
    kept = cluster_profile(members, domain, url).where(
        (F.col("domains") >= min_domains) & (F.col("core_fraction") >= min_core)
        & (F.col("images") == 0)).select("label")
    return first_per(members.join(kept, "label", "left_semi"), ["label", domain], order_by)


def discover(ads: DataFrame, domain: str = "domain", hash_col: str = "screenshot_hash",
             order_by: Sequence[str] = ("log_id", "src_file", "line_no"),
             max_bits: int = fixed.CLUSTER_BITS, min_samples: int = fixed.MIN_SAMPLES) -> DataFrame:
    """Clusters of landing pages before pruning: the first ad of each (domain, hash), so that a page
    shown again on its domain counts once, then density clusters. Feeds `prune_clusters`."""
    return dbscan(first_ads(ads, domain, hash_col, order_by), hash_col, order_by, max_bits, min_samples)


def filter_clusters(members: DataFrame, excluded: DataFrame,
                    min_size: int = fixed.MIN_CAMPAIGN_ADS) -> tuple[DataFrame, DataFrame]:
    """Drop small clusters, then those on the curated list: ``(members kept, counts)``."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    marked = sizes.join(excluded.select("label", F.lit(True).alias("_listed")).distinct(),
                        "label", "left").select(
        "label",
        F.when(F.col("size") < min_size, "undersized").when(F.col("_listed"), "excluded")
        .otherwise("kept").alias("outcome"))
    counts = marked.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("outcome") == "undersized").alias("undersized"),
        F.count_if(F.col("outcome") == "excluded").alias("excluded"),
        F.count_if(F.col("outcome") == "kept").alias("kept"))
    return members.join(marked.where("outcome = 'kept'"), "label", "left_semi"), counts


def cluster_ads(members: DataFrame, *more: DataFrame) -> DataFrame:
    """Members of several vantage points in one table; later ones only for known labels."""
    out = members
    labels = members.select("label").distinct()
    for m in more:
        out = out.unionByName(m.join(labels, "label", "left_semi"), allowMissingColumns=True)
    return out


def match_clusters(ads: DataFrame, members: DataFrame, hash_col: str = "screenshot_hash",
                   max_bits: int = fixed.MATCH_BITS) -> DataFrame:
    """``ads`` plus ``label``: the cluster that holds the same hash, else the nearest cluster
    representative within ``max_bits``, else -1. A cluster is represented by its smallest hash."""
    known = members.groupBy(hash_col).agg(F.min("label").alias("label"))
    reps = members.groupBy("label").agg(F.min(hash_col).alias("_rep"))
    mine = ads.select(hash_col).distinct().join(known, hash_col, "left")
    mine = materialise(mine)
    rest = materialise(with_lanes(mine.where("label is null").select(hash_col), hash_col))
    targets = materialise(with_lanes(
        reps.groupBy(F.col("_rep")).agg(F.min("label").alias("label")), "_rep"))
    near = near_known(rest, targets, max_bits).groupBy(F.col(f"a_{hash_col}").alias(hash_col)).agg(
        F.min(F.struct(F.col("bits"), F.col("b_label").alias("label"))).alias("m")).select(
        hash_col, "m.label")
    found = mine.where("label is not null").unionByName(near.select(hash_col, "label"))
    return ads.join(found, hash_col, "left").withColumn(
        "label", F.coalesce("label", F.lit(-1)))


def representatives(members: DataFrame,
                    order_by: Sequence[str] = ("log_id", "src_file", "line_no")) -> DataFrame:
    """First ad of each cluster, with the cluster size."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return first_per(members, ["label"], order_by).join(sizes, "label")
