"""Registrable domains by a table of public-suffix rules.

Rules are strings: ``com``, ``co.uk``, ``*.ck`` (any one label before ``ck`` is part of the suffix)
and ``!www.ck`` (an exception to such a rule). `adtrail.sources.files.read_suffix_rules` reads a
published list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adtrail.functions.urls import IPV4, host

_EXCEPTION = 1 << 20


def _rule_kinds(rules: DataFrame) -> DataFrame:
    """Rules as ``(tail, extra)``: labels that the suffix has more than the tail, or -1."""
    rule = F.lower(F.trim(F.col("rule")))
    return rules.select(rule.alias("rule")).where("rule <> ''").select(
        F.regexp_replace("rule", r"^(\*\.|!)", "").alias("_tail"),
        F.when(F.col("rule").startswith("*."), 1).when(F.col("rule").startswith("!"), -1)
        .otherwise(0).alias("_extra")).distinct()


def host_domains(hosts: DataFrame, rules: DataFrame, unlisted: bool = True) -> DataFrame:
    """``hosts(host)``, distinct, to ``(host, domain)``: the public suffix and one label more, ``""``
    for addresses and bare suffixes.

    One row per number of labels meets the rules in an equi-join; an exception beats every other
    rule, otherwise the longest suffix wins. Where no rule fits, the last label is the suffix, or
    there is no domain if ``unlisted`` is false.
    """
    labels = F.split("host", r"\.")
    named = hosts.where(~F.col("host").rlike(IPV4)).select("host", labels.alias("_labels"))
    tails = named.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_labels")),
        lambda i: F.struct(i.alias("n"), F.array_join(F.slice("_labels", -i, i), ".").alias("_tail"))
    )).alias("t")).select("host", "t.n", "t._tail")
    size = F.col("n") + F.col("_extra")
    best = tails.join(_rule_kinds(rules), "_tail").groupBy("host").agg(
        F.max(F.when(F.col("_extra") < 0, size + _EXCEPTION).otherwise(size)).alias("_best"))
    suffix = F.when(F.col("_best") >= _EXCEPTION, F.col("_best") - _EXCEPTION).otherwise(
        F.coalesce("_best", F.lit(1)))
    found = named.join(best, "host", "left" if unlisted else "inner").withColumn("_size", suffix)
    domain = F.array_join(F.slice("_labels", -(F.col("_size") + 1), F.col("_size") + 1), ".")
    return found.where(F.size("_labels") > F.col("_size")).select("host", domain.alias("domain"))


def with_domains(df: DataFrame, columns: dict[str, Column | str], rules: DataFrame,
                 unlisted: bool = True) -> DataFrame:
    """``df`` plus the registrable domain of each URL column: ``{new column: URL}``.

    Each distinct host is resolved once and joined back, so copies of a host cost nothing; a host
    that most rows share is a skewed join key on one side only, which Spark splits.
    """
    hosts = {f"_host{i}": host(url) for i, url in enumerate(columns.values())}
    marked = df.withColumns(hosts)
    distinct = marked.select(F.explode(F.array(*hosts)).alias("host")).where("host <> ''").distinct()
    resolved = host_domains(distinct, rules, unlisted)
    for key, out in zip(hosts, columns):
        marked = marked.join(resolved.toDF(key, out), key, "left").withColumn(
            out, F.coalesce(out, F.lit("")))
    return marked.drop(*hosts)


def third_party(df: DataFrame, url: Column | str, home: Column | str, rules: DataFrame,
                out: str = "third_party") -> DataFrame:
    """``df`` plus whether the URL belongs to another registrable domain than the home page."""
    both = with_domains(df, {"_domain": url, "_home_domain": home}, rules)
    return both.withColumn(out, F.col("_domain") != F.col("_home_domain")).drop("_domain", "_home_domain")
