"""Which URLs are worth polling: derivation of sources and the filter funnel."""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adtrail import fixed
from adtrail.functions import bits, urls
from adtrail.operators.cluster import nearest_known, with_lanes
from adtrail.operators.domains import with_domains
from adtrail.plans.cut import materialise
from adtrail.plans.groups import first_per

JOB = ["agent", "url"]
PAIR_BLOCK = 4096


def parse_attempts(results: DataFrame) -> DataFrame:
    """Polling results with ``agent`` and ``url`` taken from the job name."""
    job = urls.split_job("job_name")
    return results.drop("agent").withColumn("_j", job).withColumns(
        {"agent": F.col("_j.agent"), "url": F.col("_j.url")}).drop("_j")


def milking_urls(ads: DataFrame, rules: DataFrame,
                 order_by: Sequence[str] = ("log_id", "src_file", "line_no")) -> dict[str, DataFrame]:
    """Sources to poll, from clustered ads with chains.

    Walking up a chain (the landing page skipped), the first URL of another registrable domain (by
    the suffix ``rules``) is the one to poll; later ones are upstream. A blank landing page gives no
    URL to poll. Returns the tables ``ad_domains``, ``image_hashes``, ``milking_urls`` (one per
    polled domain, the first in input order) and ``upstream_domains``.
    """
    landed = materialise(with_domains(
        ads.select(*order_by, "ad_url", "screenshot_hash", "redirections"), {"ad_domain": "ad_url"}, rules
    ).withColumn("_ad", F.monotonically_increasing_id()))
    hops = landed.select("_ad", *order_by, "ad_domain", "screenshot_hash", F.posexplode("redirections").alias(
        "_hop", "_node")).where("_hop > 0 and _node.kind = 'URL'")
    other = with_domains(hops.withColumn("url", F.col("_node.value")).drop("_node"),
                         {"domain": "url"}, rules).where("domain <> ad_domain")
    # a chain is a few dozen hops at the most, so is its window
    nth = F.row_number().over(Window.partitionBy("_ad").orderBy("_hop"))
    blank = F.coalesce(F.col("screenshot_hash") == fixed.ZERO_HASH, F.lit(False))
    found = materialise(other.withColumn("_polled", (nth == 1) & ~blank))
    polled = found.where("_polled and domain <> ''").select(
        F.col("url").alias("milking_url"), "domain", *order_by)
    return {
        "ad_domains": landed.select("ad_domain").distinct(),
        "image_hashes": landed.select(F.col("screenshot_hash").alias("image_hash")).distinct(),
        "milking_urls": first_per(polled, ["domain"], order_by).select("domain", "milking_url"),
        "upstream_domains": found.where("not _polled").select(
            F.col("domain").alias("upstream_domain")).distinct(),
    }


def milking_summary(sources: dict[str, DataFrame]) -> DataFrame:
    """Sizes of the source tables and of the union of all their domains, in one aggregation of the
    tagged values."""
    columns = {"ad_domains": "ad_domain", "image_hashes": "image_hash", "milking_urls": "domain",
               "upstream_domains": "upstream_domain"}
    tagged = None
    for name, column in columns.items():
        rows = sources[name].select(F.lit(name).alias("kind"), F.col(column).alias("value"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    is_hash = F.col("kind") == "image_hashes"
    held = tagged.groupBy("value", is_hash.alias("_hash")).agg(
        *[F.max(F.col("kind") == name).alias(name) for name in columns])
    return held.agg(*[F.count_if(name).alias(name) for name in columns],
                    F.count_if(~F.col("_hash")).alias("all_domains"))


def keep_new_domain_jobs(attempts: DataFrame, ad_domains: DataFrame, rules: DataFrame,
                         landing: str = "loaded_url") -> DataFrame:
    """Jobs of which any attempt landed on a domain that is not known yet: ``(agent, url)``."""
    known = ad_domains.toDF("_landed").distinct().withColumn("_known", F.lit(True))
    landed = with_domains(attempts.select(*JOB, landing).distinct(), {"_landed": landing}, rules)
    return landed.select(*JOB, "_landed").distinct().join(known, "_landed", "left").groupBy(*JOB).agg(
        F.max(F.col("_known").isNull()).alias("_new")).where("_new").select(*JOB)


def keep_known_hash_jobs(attempts: DataFrame, hashes: DataFrame,
                         max_bits: int = fixed.SIMILAR_BITS) -> DataFrame:
    """Jobs with a known hash or, failing that, a similar one: ``(agent, url, match)``."""
    near = nearest_known(attempts.select("image_hash"), hashes.toDF("image_hash"),
                         "image_hash", max_bits)
    return attempts.select(*JOB, "image_hash").distinct().join(
        near.select("image_hash", "bits"), "image_hash").groupBy(*JOB).agg(
        F.when(F.min("bits") == 0, "same").otherwise("similar").alias("match"))


def split_by_membership(df: DataFrame, keys: DataFrame, on: Sequence[str]
                        ) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is listed, and the others."""
    marked = df.join(keys.select(*on).distinct().withColumn("_in", F.lit(True)), list(on), "left")
    return (marked.where("_in").drop("_in"), marked.where("_in is null").drop("_in"))


def linkage_exceeds(members: DataFrame, group: Sequence[str], max_bits: int,
                    block: int = PAIR_BLOCK) -> DataFrame:
    """Groups in which some hash of side A and some hash of side B differ by more than
    ``max_bits``. ``members``: group columns, ``hi``, ``lo``, ``in_a``, ``in_b``, one row per
    hash.

    Most groups are settled by two aggregations: the bits that vary at all, and the distances to
    one pivot (triangle inequality). Only undecided groups compare pairs, in blocks that meet
    once each and yield at most one row per cell.
    """
    g = list(group)
    pivot = F.min(F.when(F.col("in_b"), F.struct("hi", "lo")))
    bounds = members.groupBy(*g).agg(
        pivot.alias("p"), F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{c}") for c in ("hi", "lo")
          for name, f in (("or", F.bit_or), ("and", F.bit_and))])
    spread = bits.distance("or_hi", "or_lo", "and_hi", "and_lo")
    open_groups = bounds.where((spread > max_bits) & F.col("p").isNotNull()).select(*g, "p", "n")
    far = members.join(open_groups, g).withColumn(
        "_d", bits.distance("hi", "lo", "p.hi", "p.lo"))
    reach = far.groupBy(*g).agg(F.max(F.when(F.col("in_a"), F.col("_d"))).alias("a"),
                                F.max(F.when(F.col("in_b"), F.col("_d"))).alias("b"),
                                F.first("n").alias("n"))
    reach = materialise(reach)
    over = reach.where(F.col("a") > max_bits).select(*g)
    unsure = reach.where((F.col("a") <= max_bits) & (F.col("a") + F.col("b") > max_bits)).select(
        *g, F.ceil(F.col("n") / block).cast("int").alias("_s"))
    rows = members.join(unsure, g).withColumns({
        "_me": F.pmod(F.xxhash64("hi", "lo"), F.col("_s")).cast("int"),
        "_you": F.explode(F.sequence(F.lit(0), F.col("_s") - 1))})
    a = rows.where("in_a").select(*g, F.col("_me").alias("_i"), F.col("_you").alias("_j"),
                                  F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    b = rows.where("in_b").select(*g, F.col("_you").alias("_i"), F.col("_me").alias("_j"),
                                  F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    apart = a.join(b, [*g, "_i", "_j"]).where(
        bits.distance("a_hi", "a_lo", "b_hi", "b_lo") > max_bits).select(*g).distinct()
    return over.unionByName(apart)


def homogeneous_jobs(attempts: DataFrame, max_bits: int = fixed.SIMILAR_BITS) -> DataFrame:
    """Per job: whether all its non-blank hashes lie within ``max_bits`` of each other."""
    jobs = attempts.select(*JOB).distinct()
    hashes = attempts.where(F.col("image_hash") != fixed.ZERO_HASH).select(
        *JOB, "image_hash").distinct()
    members = with_lanes(hashes, "image_hash").select(
        *JOB, "hi", "lo", F.lit(True).alias("in_a"), F.lit(True).alias("in_b"))
    mixed = linkage_exceeds(members, JOB, max_bits).distinct().withColumn("_m", F.lit(True))
    return jobs.join(mixed, JOB, "left").select(*JOB, F.col("_m").isNull().alias("homogeneous"))


def sets_similar(a: Column, b: Column, max_bits: int = fixed.SIMILAR_BITS) -> Column:
    """Two small arrays of hashes: every hash only in ``a`` is near every hash of ``b``."""
    return F.forall(F.array_except(a, b),
                    lambda x: F.forall(b, lambda y: bits.hamming(x, y) <= max_bits))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def union_sets(df: DataFrame, key: str, values: str) -> DataFrame:
    """Union of array-valued sets per key, one row per distinct element."""
    return df.select(key, F.explode(values).alias(values)).distinct()


def dedupe_agents(attempts: DataFrame, preference: Sequence[str] = fixed.AGENT_PREFERENCE,
                  max_bits: int = fixed.SIMILAR_BITS) -> DataFrame:
    """Jobs left after dropping agents that see what a preferred agent sees: ``(agent, url)``.

    Two agents are alike on a URL if their landing URLs form the same set and every hash that
    only the preferred one saw is near every hash of the other. Sets are compared as bit masks
    of agents per distinct value, so no set is ever collected.
    """
    ranks = {a: i for i, a in enumerate(preference)}
    bit = F.coalesce(*[F.when(F.col("agent") == a, 1 << i) for a, i in ranks.items()])
    known = attempts.where(F.col("agent").isin(*preference))
    pairs = list(combinations(range(len(preference)), 2))

    def has(mask: str, r: int) -> Column:
        return F.col(mask).bitwiseAND(F.lit(1 << r)) != 0

    landed = known.groupBy("url", "loaded_url").agg(F.bit_or(bit).alias("m"))
    urls_differ = landed.groupBy("url").agg(
        F.bit_or("m").alias("agents"),
        *[F.max(has("m", i) != has("m", j)).alias(f"d{i}{j}") for i, j in pairs])

    seen = known.groupBy("url", "image_hash").agg(F.bit_or(bit).alias("m"))
    sided = with_lanes(seen, "image_hash").select("url", "hi", "lo", F.explode(F.array(*[
        F.struct(F.lit(f"{i}{j}").alias("pair"), (has("m", i) & ~has("m", j)).alias("in_a"),
                 has("m", j).alias("in_b")) for i, j in pairs])).alias("s")).select(
        "url", "hi", "lo", "s.*").where("in_a or in_b")
    # only pairs of agents whose landing URLs agree need their hashes compared
    alike = urls_differ.select("url", F.explode(F.array(*[
        F.struct(F.lit(f"{i}{j}").alias("pair"),
                 (~F.col(f"d{i}{j}") & has("agents", i)).alias("same")) for i, j in pairs]))
        .alias("s")).select("url", "s.*").where("same").select("url", "pair")
    apart = linkage_exceeds(materialise(sided.join(alike, ["url", "pair"])), ["url", "pair"],
                            max_bits)
    similar = alike.join(apart.distinct(), ["url", "pair"], "left_anti")
    flags = similar.groupBy("url").agg(*[
        F.max(F.col("pair") == f"{i}{j}").alias(f"s{i}{j}") for i, j in pairs])
    judged = urls_differ.select("url", "agents").join(flags, "url", "left")
    # most preferred first: an agent goes when a kept, more preferred one is like it
    for j in range(len(preference)):
        gone = F.lit(False)
        for i in range(j):
            gone = gone | (F.col(f"k{i}") & F.coalesce(f"s{i}{j}", F.lit(False)))
        judged = judged.withColumn(f"k{j}", has("agents", j) & ~gone)
    kept = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"k{i}").alias("keep"))
                               for a, i in ranks.items()]))
    return judged.select("url", kept.alias("k")).where("k.keep").select("k.agent", "url")


def milking_funnel(attempts: DataFrame, sources: dict[str, DataFrame], expected: DataFrame,
                   rules: DataFrame, preference: Sequence[str] = fixed.AGENT_PREFERENCE
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All filters in turn: ``(jobs kept, upstream jobs, jobs left after each stage)``.

    ``expected``: the (agent, url) jobs of the current source list; ``rules``: public-suffix rules.
    Each stage is a small table of job keys; the attempts themselves are only read, never rewritten.
    """
    new = materialise(keep_new_domain_jobs(attempts, sources["ad_domains"], rules))
    after_new = attempts.join(new, JOB, "left_semi")
    matched = materialise(keep_known_hash_jobs(after_new, sources["image_hashes"]))
    listed, other = split_by_membership(matched, expected, JOB)
    listed = materialise(listed)
    up, rest = split_by_membership(
        with_domains(listed, {"upstream_domain": "url"}, rules), sources["upstream_domains"].toDF(
            "upstream_domain"), ["upstream_domain"])
    rest = materialise(rest.select(*JOB))
    upstream = materialise(other.select(*JOB).unionByName(up.select(*JOB)))
    kept = materialise(dedupe_agents(attempts.join(rest, JOB, "left_semi"), preference))

    def stage(i: int, name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("jobs")).select(
            F.lit(i).alias("stage"), F.lit(name).alias("name"), "jobs")

    counts = (stage(0, "all", attempts.select(*JOB).distinct())
              .unionByName(stage(1, "new_domain", new))
              .unionByName(stage(2, "known_hash", matched))
              .unionByName(stage(3, "expected", listed))
              .unionByName(stage(4, "not_upstream", rest))
              .unionByName(stage(5, "distinct_agent", kept)))
    return kept.select(*JOB), upstream, counts


def milk_sources(attempts: DataFrame, kept: DataFrame, upstream: DataFrame) -> DataFrame:
    """Source lines to poll: ``(job_name, image_hash, category)``, one row per non-blank hash.

    ``kept`` and ``upstream`` are (agent, url) jobs; the attempts are read once. The job name is
    the first one of the job; a job that saw blank pages only keeps one row with a NULL hash.
    """
    listed = materialise(kept.select(*JOB, F.lit("MILKING").alias("category")).unionByName(
        upstream.select(*JOB, F.lit("UPSTREAM").alias("category"))))
    hash_ = F.when(F.col("image_hash") != fixed.ZERO_HASH, F.col("image_hash"))
    seen = attempts.join(listed, JOB).groupBy(*JOB, "category", hash_.alias("image_hash")).agg(
        F.min("job_name").alias("job_name"))
    named = seen.groupBy(*JOB, "category").agg(F.min("job_name").alias("job_name"),
                                               F.count("image_hash").alias("_hashes"))
    rows = seen.drop("job_name").join(named, [*JOB, "category"])
    return rows.where(F.col("image_hash").isNotNull() | (F.col("_hashes") == 0)).select(
        "job_name", "image_hash", "category")


def job_time(results: DataFrame, seconds: str = "total_time") -> DataFrame:
    return results.agg(F.sum(seconds).alias("total"), F.count(seconds).alias("jobs"),
                       F.avg(seconds).alias("mean"))


def download_rate(results: DataFrame) -> DataFrame:
    """Attempts with a download, attempts, and jobs without any download."""
    per_job = results.groupBy(*JOB).agg(
        F.count_if(F.col("downloaded_files") == "True").alias("with"),
        F.count(F.lit(1)).alias("n"))
    return per_job.agg(F.sum("with").alias("attempts_with_download"),
                       F.sum("n").alias("attempts"),
                       F.count_if(F.col("with") == 0).alias("jobs_without_download"))


def find_hash(attempts: DataFrame, image_hash: str | Column,
              max_bits: int = fixed.SIMILAR_BITS) -> DataFrame:
    """Jobs that saw a hash near the given one: a value, or a column such as a scalar subquery."""
    wanted = F.lit(image_hash) if isinstance(image_hash, str) else image_hash
    return attempts.where(bits.hamming("image_hash", wanted) <= max_bits).select(
        *JOB).distinct()
