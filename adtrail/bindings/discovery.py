"""Queries: URL parts, hashes, similarity, clusters, attribution, campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adtrail import fixed
from adtrail.bindings import inputs as I
from adtrail.bindings.inputs import table
from adtrail.bindings.registry import query
from adtrail.functions import bits, urls
from adtrail.operators import attribution, campaigns, cluster, domains, tracking

_PAGES = f"{I.PAGE_URLS}, {I.domains_sql('SELECT url FROM pu')}"


@query("url_parts", f"""
WITH {_PAGES} SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query, domain,
  host AS fqdn, regexp_extract(url, '[.]([^./?#]*)(?:[?#].*)?$', 1)
    IN ('png','gif','jpg') AS image FROM pu JOIN dom ON host = {I.host_sql('url')}""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    pages = domains.with_domains(I.page_urls(spark, sf), {"domain": "url"}, I.suffix_rules(spark))
    return pages.select(
        "page_id", urls.netloc("url").alias("netloc"), urls.url_path("url").alias("path"),
        urls.url_query("url").alias("query"), "domain",
        urls.fqdn("url").alias("fqdn"), urls.is_image_url("url").alias("image"))


# shops of customers under all kinds of suffixes, a third of them without a name of their own
_SHOPS = f"""sh AS MATERIALIZED (SELECT CASE c_custkey % 3 WHEN 0 THEN 'http://' WHEN 1 THEN 'https://www.shop'
    || (c_custkey % 40) || '.' ELSE '//u:p@a.b.Shop' || (c_custkey % 40) || '.' END ||
    {I.ending_sql('c_custkey // 3')} || CASE WHEN c_custkey % 2 = 0 THEN ':8080/x' ELSE './y' END AS url
  FROM customer)"""


@query("registered_domain_by_rules", f"""WITH {_SHOPS},
  clean AS (SELECT 'http://' || lower(regexp_extract(url, '//(?:[^@/]*@)?([^:/]*[^:/.])[.]?[:/]', 1)) AS url FROM sh),
  {I.domains_sql('SELECT url FROM clean')}
SELECT domain, count(*) AS shops FROM clean JOIN dom ON host = {I.host_sql('url')} GROUP BY 1""")
def registered_by_rules(spark, sf):
    k = F.col("c_custkey")
    n = (k % 40).cast("string")
    head = F.when(k % 3 == 0, "http://").when(k % 3 == 1, F.concat(F.lit("https://www.shop"), n, F.lit("."))).otherwise(
        F.concat(F.lit("//u:p@a.b.Shop"), n, F.lit(".")))
    shops = table(spark, sf, "customer").select(F.concat(
        head, I.ending(F.floor(k / 3)), F.when(k % 2 == 0, ":8080/x").otherwise("./y")).alias("url"))
    return domains.with_domains(shops, {"domain": "url"}, I.suffix_rules(spark)).groupBy("domain").agg(
        F.count(F.lit(1)).alias("shops"))


@query("third_party_pages", f"""WITH {_PAGES}, two AS (SELECT d.domain AS domain, h.domain AS home
  FROM pu a JOIN pu b ON b.page_id = a.page_id - a.page_id % 27
    JOIN dom d ON d.host = {I.host_sql('a.url')} JOIN dom h ON h.host = {I.host_sql('b.url')})
SELECT domain, count(*) AS pages, count(*) FILTER (WHERE domain <> home) AS third_party FROM two GROUP BY 1""")
def third_party_pages(spark, sf):
    pages = I.page_urls(spark, sf)
    homes = pages.select(F.col("page_id").alias("_home"), F.col("url").alias("home"))
    pages = pages.withColumn("_home", F.col("page_id") - F.col("page_id") % 27).join(homes, "_home")
    seen = domains.third_party(pages, "url", "home", I.suffix_rules(spark))
    return domains.with_domains(seen, {"domain": "url"}, I.suffix_rules(spark)).groupBy("domain").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("third_party").alias("third_party"))


@query("job_names", """
SELECT page_id, 'chrome_mac' AS agent, url, 'chrome_mac:' || url_encode(url) AS job_name FROM pages""")
def job_names(spark, sf):
    named = table(spark, sf, "pages").select(
        "page_id", urls.make_job(F.lit("chrome_mac"), "url").alias("job_name"))
    return named.withColumn("j", urls.split_job("job_name")).select(
        "page_id", "j.agent", "j.url", "job_name")


@query("document_hash", f"WITH {I.DOC_HASHES} SELECT doc_id, screenshot_hash FROM dh")
def document_hash(spark, sf):
    return I.document_hashes(spark, sf).select("doc_id", "screenshot_hash")


@query("hash_distance", f"""
WITH {I.DOC_HASHES} SELECT a.doc_id, {I.ham_sql('a.screenshot_hash', 'b.screenshot_hash')}::INT AS bits
FROM dh a JOIN dh b ON b.doc_id = a.doc_id + 1""")
def hash_distance(spark, sf):
    h = I.document_hashes(spark, sf).select("doc_id", "screenshot_hash")
    after = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("screenshot_hash").alias("next"))
    return h.join(after, "doc_id").select(
        "doc_id", bits.hamming("screenshot_hash", "next").cast("int").alias("bits"))


_BITS49 = [(y * 8 + x, s) for s in (1, 8) for y in range(7) for x in range(7)]
_PACK = ["(" + "+".join(f"(embedding[{a + 1}]<embedding[{a + s + 1}])::BIGINT*{1 << (48 - i)}"
                        for i, (a, s) in enumerate(_BITS49[j:j + 49])) + ")" for j in (0, 49)]


@query("gradient_hash", "SELECT vec_id, " + " || ".join(
    f"lower(lpad(to_hex({p}), 13, '0'))" for p in _PACK) + " AS hash FROM embeddings")
def gradient_hash(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", bits.dhash("embedding", 7).alias("hash"))


@query("similar_hash_pairs", f"""
WITH {I.DOC_HASHES}, d AS (SELECT DISTINCT screenshot_hash AS h FROM dh)
SELECT a.h AS hash_a, b.h AS hash_b, {I.ham_sql('a.h', 'b.h')}::INT AS bits
FROM d a JOIN d b ON a.h < b.h WHERE {I.ham_sql('a.h', 'b.h')} <= 6""")
def similar_hash_pairs(spark, sf):
    return cluster.similar_pairs(I.document_hashes(spark, sf), "screenshot_hash",
                                 fixed.CLUSTER_BITS)


_SIGN = "CASE WHEN embedding[{}] > 0 THEN {} ELSE 0 END"
_SIGN_HEX = " || ".join(
    "substr('0123456789abcdef', 1+" + "+".join(
        _SIGN.format(i + j + 1, 8 >> j) for j in range(4)) + ", 1)" for i in range(0, 64, 4))


@query("similar_embedding_pairs", f"""
WITH d AS (SELECT DISTINCT lpad({_SIGN_HEX}, 32, '0') AS h FROM embeddings)
SELECT a.h AS hash_a, b.h AS hash_b, {I.ham_sql('a.h', 'b.h')}::INT AS bits
FROM d a JOIN d b ON a.h < b.h WHERE {I.ham_sql('a.h', 'b.h')} <= 16""")
def similar_embedding_pairs(spark, sf):
    sign = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    hexed = F.concat(*[F.lower(F.lpad(F.conv(F.substring("b", 1 + 32 * i, 32), 2, 16), 8, "0"))
                       for i in range(2)])
    df = table(spark, sf, "embeddings").select(sign.alias("b")).select(
        F.lpad(hexed, 32, "0").alias("h"))
    return cluster.similar_pairs(df, "h", 16)


@query("known_hash_matches", f"""
WITH {I.DOC_HASHES}, {I.TOXIC}, d AS (SELECT DISTINCT screenshot_hash AS h FROM dh),
m AS (SELECT d.h, b.screenshot_hash AS known, {I.ham_sql('d.h', 'b.screenshot_hash')}::INT AS bits
      FROM d JOIN bad b ON {I.ham_sql('d.h', 'b.screenshot_hash')} <= 13)
SELECT h AS screenshot_hash, known, bits FROM (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY bits, known) AS rn FROM m) WHERE rn = 1""")
def known_hash_matches(spark, sf):
    hashes = I.document_hashes(spark, sf)
    return cluster.nearest_known(hashes, I.toxic_hashes(spark, sf, hashes), "screenshot_hash",
                                 fixed.SIMILAR_BITS)


@query("similar_to_known", f"""
WITH {I.DOC_HASHES}, {I.TOXIC} SELECT doc_id FROM dh WHERE EXISTS (SELECT 1 FROM bad b
  WHERE {I.ham_sql('dh.screenshot_hash', 'b.screenshot_hash')} <= 13)""")
def similar_to_known(spark, sf):
    hashes = I.document_hashes(spark, sf)
    return cluster.similar_to(hashes, I.toxic_hashes(spark, sf, hashes), "screenshot_hash").select("doc_id")


@query("first_ads", """
SELECT source, md5(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def first_ads(spark, sf):
    df = table(spark, sf, "documents").select("source", F.md5("text").alias("hash"), "doc_id")
    return cluster.first_ads(df, "source", "hash", ["doc_id"])


@query("exact_domain_clusters", """
SELECT md5(text) AS hash, count(DISTINCT source) AS domains FROM documents GROUP BY 1
HAVING count(DISTINCT source) >= 2""")
def exact_domain_clusters(spark, sf):
    df = table(spark, sf, "documents").select("source", F.md5("text").alias("hash"))
    return cluster.exact_domain_clusters(df, "source", "hash", 2)


@query("exact_clusters", """
SELECT hash, count(*) AS images FROM (SELECT source || lang || (n_chars // 100) AS domain,
  arg_max(md5(text), doc_id) AS hash FROM documents GROUP BY 1) GROUP BY 1 HAVING count(*) >= 2""")
def exact_clusters(spark, sf):
    df = table(spark, sf, "documents").select(
        F.concat("source", "lang", F.floor(F.col("n_chars") / 100).cast("string")).alias("domain"),
        F.md5("text").alias("hash"), "doc_id")
    return cluster.exact_clusters(df, "domain", "hash", ["doc_id"])


@query("dense_ids", """
SELECT text_hash, row_number() OVER (ORDER BY first) - 1 AS id FROM (
  SELECT md5(text) AS text_hash, min(doc_id) AS first FROM documents GROUP BY 1)""")
def dense_ids(spark, sf):
    df = table(spark, sf, "documents").select(F.md5("text").alias("text_hash"), "doc_id")
    return cluster.dense_ids(df, "text_hash", ["doc_id"])


# DBSCAN over the distinct hashes: neighbours by brute force, components by recursion
DBSCAN = I.DOC_ADS + f""", hs AS MATERIALIZED (SELECT screenshot_hash AS h, count(*) AS n,
    min(line_no) AS first FROM ads GROUP BY 1),
  nb AS MATERIALIZED (SELECT a.h AS a, b.h AS b, b.n FROM hs a JOIN hs b
    ON a.h <> b.h AND {I.ham_sql('a.h', 'b.h')} <= 6),
  core AS MATERIALIZED (SELECT hs.h, hs.first FROM hs LEFT JOIN (
    SELECT a, sum(n) AS n FROM nb GROUP BY 1) x ON x.a = hs.h WHERE hs.n + coalesce(x.n, 0) >= 3),
  ce AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (SELECT h FROM core)
    AND b IN (SELECT h FROM core)),
  reach AS (WITH RECURSIVE r(h, root) AS (SELECT h, first FROM core UNION
    SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.h) SELECT h, min(root) AS root FROM r GROUP BY 1),
  labelled AS MATERIALIZED (SELECT h, dense_rank() OVER (ORDER BY root) - 1 AS label FROM reach),
  border AS (SELECT nb.a AS h, min(label) AS label FROM nb JOIN labelled l ON l.h = nb.b
    WHERE nb.a NOT IN (SELECT h FROM core) GROUP BY 1),
  members AS MATERIALIZED (SELECT ads.*, coalesce(l.label, b.label, -1) AS cluster,
    l.h IS NOT NULL AS is_core FROM ads LEFT JOIN labelled l ON l.h = ads.screenshot_hash
    LEFT JOIN border b ON b.h = ads.screenshot_hash)"""


def _dbscan(spark, sf):
    ads = I.document_ads(spark, sf).drop("label")
    return cluster.dbscan(ads, order_by=["line_no"])


@query("dbscan", f"WITH {DBSCAN} SELECT log_id, cluster AS label, is_core FROM members")
def dbscan(spark, sf):
    return _dbscan(spark, sf).select("log_id", "label", "is_core")


# the same after the first ad of each domain and hash, and every ad stored twice
DISCOVERY = DBSCAN.replace("hs AS MATERIALIZED", """w1 AS MATERIALIZED (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY domain, screenshot_hash ORDER BY line_no) AS first_one FROM ads)
    WHERE first_one = 1), hs AS MATERIALIZED""").replace("FROM ads GROUP BY 1", "FROM w1 GROUP BY 1").replace(
    "members AS MATERIALIZED (SELECT ads.*", "members AS MATERIALIZED (SELECT w1.*").replace(
    "FROM ads LEFT JOIN labelled l ON l.h = ads.screenshot_hash", "FROM w1 LEFT JOIN labelled l ON l.h = w1.screenshot_hash"
    ).replace("border b ON b.h = ads.screenshot_hash", "border b ON b.h = w1.screenshot_hash")


def _discovered(spark, sf):
    ads = I.document_ads(spark, sf).drop("label")
    again = ads.withColumns({"line_no": F.col("line_no") + 1_000_000_000, "log_id": F.lit("again")})
    return cluster.discover(ads.unionByName(again), order_by=["line_no"])


@query("cluster_profile", f"""WITH {DISCOVERY} SELECT cluster AS label, count(*) AS size,
  count(DISTINCT domain) AS domains, count(*) FILTER (WHERE is_core) AS cores,
  count(*) FILTER (WHERE ad_url LIKE '%.png') AS images,
  count(*) FILTER (WHERE is_core) / count(*) AS core_fraction
FROM members WHERE cluster >= 0 GROUP BY 1""")
def cluster_profile(spark, sf):
    return cluster.cluster_profile(_discovered(spark, sf))


_PRUNED = DISCOVERY + """, kept AS (SELECT cluster FROM members WHERE cluster >= 0 GROUP BY 1
    HAVING count(DISTINCT domain) >= 3 AND avg(is_core::INT) >= 0.5
      AND count(*) FILTER (WHERE ad_url LIKE '%.png') = 0),
  pruned AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY cluster, domain ORDER BY line_no) AS rn FROM members
    WHERE cluster IN (SELECT cluster FROM kept)) WHERE rn = 1)"""


def _pruned(spark, sf):
    return cluster.prune_clusters(_discovered(spark, sf), order_by=["line_no"])


@query("campaign_discovery",
       f"WITH {_PRUNED} SELECT cluster AS label, log_id, domain, ad_url FROM pruned")
def campaign_discovery(spark, sf):
    return _pruned(spark, sf).select("label", "log_id", "domain", "ad_url")


@query("cluster_representatives", f"""WITH {_PRUNED} SELECT cluster AS label,
  arg_min(log_id, line_no) AS log_id, count(*) AS size FROM pruned GROUP BY 1""")
def cluster_representatives(spark, sf):
    return cluster.representatives(_pruned(spark, sf), ["line_no"]).select(
        "label", "log_id", "size")


_V3 = I.DOC_ADS + f""", w1 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY domain, screenshot_hash ORDER BY line_no) AS rn FROM ads) WHERE rn = 1),
  hp AS MATERIALIZED (SELECT a.h AS a, b.h AS b FROM (SELECT DISTINCT screenshot_hash AS h FROM w1) a
    JOIN (SELECT DISTINCT screenshot_hash AS h FROM w1) b ON {I.ham_sql('a.h', 'b.h')} <= 6),
  nb AS MATERIALIZED (SELECT x.line_no AS a, y.line_no AS b FROM w1 x
    JOIN hp ON hp.a = x.screenshot_hash
    JOIN w1 y ON y.screenshot_hash = hp.b AND x.domain <> y.domain),
  core AS MATERIALIZED (SELECT a AS h FROM nb GROUP BY 1 HAVING count(*) >= 3),
  ce AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (SELECT h FROM core)
    AND b IN (SELECT h FROM core)),
  reach AS (WITH RECURSIVE r(h, root) AS (SELECT h, h FROM core UNION
    SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.h) SELECT h, min(root) AS root FROM r GROUP BY 1),
  labelled AS MATERIALIZED (SELECT h, dense_rank() OVER (ORDER BY root) - 1 AS label FROM reach),
  border AS (SELECT nb.a AS h, min(label) AS label FROM nb JOIN labelled l ON l.h = nb.b
    WHERE nb.a NOT IN (SELECT h FROM core) GROUP BY 1)"""


@query("dbscan_other_domain", f"""WITH {_V3} SELECT log_id, coalesce(l.label, b.label, -1) AS label,
  l.h IS NOT NULL AS is_core FROM w1 LEFT JOIN labelled l ON l.h = line_no
  LEFT JOIN border b ON b.h = line_no""")
def dbscan_other_domain(spark, sf):
    ads = cluster.first_ads(I.document_ads(spark, sf).drop("label"), order_by=["line_no"])
    return cluster.dbscan(ads, order_by=["line_no"], other_group="domain",
                          count_self=False).select("log_id", "label", "is_core")


# clusters for the operators below: equal texts, numbered by first appearance
_EXACT = """ex AS MATERIALIZED (SELECT doc_id, source, lang, id AS label, md5(text) AS hash FROM documents
  JOIN (SELECT h, row_number() OVER (ORDER BY first) - 1 AS id FROM (
    SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1
    HAVING count(*) >= 2)) ON h = md5(text))"""


def _exact_members(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "source", "lang", F.md5("text").alias("hash"))
    sizes = df.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    ids = cluster.dense_ids(sizes.where("n >= 2"), "hash", ["first"], "label")
    return df.join(ids, "hash")


def _excluded(spark):
    return spark.createDataFrame([(l, why) for why, ls in fixed.EXCLUDED_LABELS.items()
                                  for l in ls], "label int, why string")


def _campaign_map(spark):
    return spark.createDataFrame([(c, l) for c, ls in fixed.CAMPAIGN_LABELS.items() for l in ls],
                                 "category string, label int")


_LISTED = ", ".join(str(l) for ls in fixed.EXCLUDED_LABELS.values() for l in ls)
_MAPPED = ", ".join(f"({l})" for ls in fixed.CAMPAIGN_LABELS.values() for l in ls)


@query("filter_clusters", f"""WITH {_EXACT}, s AS (SELECT label, count(*) AS n FROM ex GROUP BY 1)
SELECT count(*) AS clusters, count(*) FILTER (WHERE n < 3) AS undersized,
  count(*) FILTER (WHERE n >= 3 AND label IN ({_LISTED})) AS excluded,
  count(*) FILTER (WHERE n >= 3 AND label NOT IN ({_LISTED})) AS kept FROM s""")
def filter_clusters(spark, sf):
    return cluster.filter_clusters(_exact_members(spark, sf), _excluded(spark), 3)[1]


@query("curation_gaps", f"""WITH {_EXACT}, c AS (SELECT DISTINCT label FROM ex),
m AS (SELECT * FROM (VALUES {_MAPPED}) t(label))
SELECT (SELECT count(*) FROM c) AS clusters, (SELECT count(*) FROM m) AS mapped,
  (SELECT count(*) FROM c WHERE label NOT IN (SELECT label FROM m)) AS missing""")
def curation_gaps(spark, sf):
    return campaigns.curation_gaps(_exact_members(spark, sf), _campaign_map(spark))[1]


@query("match_clusters", f"""WITH {I.DOC_HASHES}, grp AS (SELECT dh.screenshot_hash AS h,
    min(quality * 10 + toxic) AS label FROM dh JOIN labels USING (doc_id) GROUP BY 1),
  mem AS (SELECT dh.screenshot_hash AS h, dh.doc_id // 7 AS label FROM dh JOIN labels USING (doc_id)),
  reps AS (SELECT label, min(h) AS rep FROM mem GROUP BY 1),
  known AS (SELECT h, min(label) AS label FROM mem GROUP BY 1),
  d AS (SELECT DISTINCT screenshot_hash AS h FROM dh),
  near AS (SELECT h, label FROM (SELECT d.h, r.label, row_number() OVER (PARTITION BY d.h
    ORDER BY {I.ham_sql('d.h', 'r.rep')}, r.label) AS rn FROM d JOIN reps r
    ON {I.ham_sql('d.h', 'r.rep')} <= 12) WHERE rn = 1)
SELECT doc_id, coalesce(known.label, near.label, -1) AS label FROM dh
LEFT JOIN known ON known.h = dh.screenshot_hash LEFT JOIN near ON near.h = dh.screenshot_hash""")
def match_clusters(spark, sf):
    docs = I.document_hashes(spark, sf).select("doc_id", "screenshot_hash")
    members = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        "screenshot_hash", F.floor(F.col("doc_id") / 7).alias("label"))
    return cluster.match_clusters(docs, members).select("doc_id", "label")


@query("cluster_ads", """
WITH m AS (SELECT doc_id, source AS label FROM documents WHERE doc_id IN (
    SELECT doc_id FROM labels WHERE quality = 1)),
  r AS (SELECT doc_id, source AS label FROM documents WHERE doc_id IN (
    SELECT doc_id FROM labels WHERE quality = 0))
SELECT label, count(*) AS ads FROM (SELECT * FROM m UNION ALL
  SELECT * FROM r WHERE label IN (SELECT label FROM m)) GROUP BY 1""")
def cluster_ads(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    labels = table(spark, sf, "labels")
    both = [docs.join(labels.where(f"quality = {q}"), "doc_id", "left_semi") for q in (1, 0)]
    return cluster.cluster_ads(*both).groupBy("label").agg(F.count(F.lit(1)).alias("ads"))


# --- attribution ---------------------------------------------------------------------------
def _rules_sql(u: str) -> str:
    at = f"regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"
    path = f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    q = f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"
    p_hosts = ", ".join(f"'{h}'" for h in fixed.PROPELLER_HOSTS)
    c_hosts = ", ".join(f"'{h}'" for h in fixed.CLICKADU_HOSTS)
    return f"""CASE
    WHEN ({path} = '/adServe/banners' AND {q} LIKE 'tid=%')
      OR regexp_matches({path}, '^/banners/script/ui_tag_.*[.]js$')
      OR regexp_matches({path}, '^/script/rhpop_.*[.]js$') THEN 'RevenueHits'
    WHEN {at} LIKE '%.popcash.net' THEN 'PopCash'
    WHEN {path} = '/prod/redirect.html' AND {q} <> '' THEN 'AdCash'
    WHEN {at} LIKE '%.popads.net' THEN 'PopAds'
    WHEN {at} = 'popmyads.com' THEN 'PopMyAds'
    WHEN length({path}) = 45 AND {path} LIKE '%.js' AND {path}[4] = '/' AND {path}[7] = '/'
      AND {path}[10] = '/' AND {path}[2:3] || {path}[5:6] || {path}[8:9] = {path}[11:16]
      THEN 'AdSterra'
    WHEN {at} = 'hilltopads.net' OR ({path} = '/out' AND {q} LIKE 'vt=%') THEN 'HilltopAds'
    WHEN {at} LIKE '%.clicksor.net' THEN 'Clicksor'
    WHEN {at} LIKE '%.cloudfront.net' AND regexp_full_match({q}, '[a-z]{{5}}=[0-9]{{6}}')
      THEN 'AdMaven'
    WHEN {path} = '/apu.php' AND {at} IN ({p_hosts}) THEN 'Propeller'
    WHEN {path} = '/apu.php' AND {at} IN ({c_hosts}) THEN 'Clickadu' END"""


_NETWORK = I.PAGE_ADS + f""", net AS MATERIALIZED (SELECT *, coalesce(n2, n1, 'Unknown') AS network,
    CASE WHEN n2 IS NOT NULL THEN regexp_extract(hop2, '^[a-z]+://([^/?#]*)', 1)
         WHEN n1 IS NOT NULL THEN regexp_extract(hop1, '^[a-z]+://([^/?#]*)', 1) END AS network_host
  FROM (SELECT *, {_rules_sql('hop1')} AS n1, {_rules_sql('hop2')} AS n2 FROM pa)), {I.TOXIC}"""


def _networks(spark, sf, hashes=None):
    return attribution.identify_network(I.page_ads(spark, sf, hashes))


@query("identify_network",
       f"WITH {_NETWORK} SELECT p::VARCHAR AS log_id, network, network_host FROM net")
def identify_network(spark, sf):
    return _networks(spark, sf).select("log_id", "network", "network_host")


_NAMES = ", ".join(f"('{n}')" for n in fixed.NETWORKS)


@query("network_counts", f"""WITH {_NETWORK}, c AS (SELECT name AS network, count(p) AS ads,
    count(p) FILTER (WHERE screenshot_hash IN (SELECT screenshot_hash FROM bad)) AS malicious_ads
  FROM (VALUES {_NAMES}) t(name) LEFT JOIN net ON network = name GROUP BY 1)
SELECT * FROM c UNION ALL SELECT 'total', sum(ads)::BIGINT, sum(malicious_ads)::BIGINT FROM c""")
def network_counts(spark, sf):
    hashes = I.document_hashes(spark, sf)
    return attribution.network_counts(_networks(spark, sf, hashes), I.toxic_hashes(spark, sf, hashes))


@query("network_hosts", f"""WITH {_NETWORK}, d AS (SELECT DISTINCT network, network_host FROM net
  WHERE network <> 'Unknown'), r AS (SELECT *, row_number() OVER (PARTITION BY network
  ORDER BY network_host) AS rn FROM d) SELECT network, count(*) AS hosts,
  string_agg(network_host, ' ' ORDER BY network_host) FILTER (WHERE rn <= 10) AS sample
FROM r GROUP BY 1""")
def network_hosts(spark, sf):
    return attribution.network_hosts(_networks(spark, sf)).withColumn(
        "sample", F.array_join("sample", " "))


@query("malicious_ads", f"""WITH {I.DOC_HASHES}, {I.TOXIC} SELECT
  screenshot_hash IN (SELECT screenshot_hash FROM bad) AS malicious, count(*) AS ads FROM dh
GROUP BY 1""")
def malicious_ads(spark, sf):
    hashes = I.document_hashes(spark, sf)
    return attribution.flag_malicious(hashes, I.toxic_hashes(spark, sf, hashes)).groupBy("malicious").agg(
        F.count(F.lit(1)).alias("ads"))


@query("malicious_hash_counts", f"""WITH {_EXACT}
SELECT count(DISTINCT hash) AS hashes, count(*) AS ads FROM ex""")
def malicious_hash_counts(spark, sf):
    m = _exact_members(spark, sf)
    return attribution.malicious_hashes(
        m.where("lang = 'en'"), m.where("lang <> 'en'"), hash_col="hash")[1]


# --- campaigns -----------------------------------------------------------------------------
_CAMPAIGN = I.DOC_ADS + """, allads AS (SELECT * FROM ads WHERE line_no IN (SELECT doc_id FROM labels)),
  cmap AS (SELECT DISTINCT 'cat' || (label % 6) AS category, label FROM ads),
  mem AS (SELECT ads.*, category, regexp_extract(ad_url, '^[a-z]+://([^/?#]*)', 1) AS landing
    FROM ads JOIN cmap USING (label)),
  cnt AS (SELECT screenshot_hash, count(*) AS n FROM allads GROUP BY 1),
  own AS (SELECT screenshot_hash, min((category, label)) AS o, any_value(n) AS n
    FROM mem JOIN cnt USING (screenshot_hash) GROUP BY 1),
  alone AS (SELECT * FROM mem WHERE screenshot_hash NOT IN (SELECT screenshot_hash FROM cnt)),
  att AS (SELECT category, sum(n) AS attacks FROM (SELECT o[1] AS category, n FROM own
    UNION ALL SELECT category, 1 FROM alone) GROUP BY 1),
  land AS (SELECT DISTINCT o[1] AS category, o[2]::INT AS label,
      regexp_extract(ad_url, '^[a-z]+://([^/?#]*)', 1) AS landing
    FROM own JOIN allads USING (screenshot_hash)
    UNION SELECT category, label, landing FROM alone),
  pub AS (SELECT DISTINCT o[1] AS category, seed_domain FROM own JOIN allads USING (screenshot_hash)),
  threat AS (SELECT 'en.src' || n_nationkey || '-example.com' AS d FROM nation),
  per AS (SELECT category, count(DISTINCT label) AS clusters,
    coalesce((SELECT attacks FROM att WHERE att.category = cmap.category), 0) AS attacks,
    (SELECT count(DISTINCT landing) FROM land WHERE land.category = cmap.category) AS landing_domains,
    (SELECT count(DISTINCT label) FROM land WHERE land.category = cmap.category
      AND landing IN (SELECT d FROM threat)) AS flagged_clusters,
    (SELECT count(*) FROM pub WHERE pub.category = cmap.category) AS publishers
    FROM cmap GROUP BY category)"""


def _campaign_inputs(spark, sf):
    ads = I.document_ads(spark, sf)
    all_ads = ads.join(table(spark, sf, "labels").select(F.col("doc_id").alias("line_no")),
                       "line_no", "left_semi")
    cmap = ads.select(F.concat(F.lit("cat"), (F.col("label") % 6).cast("string")).alias("category"),
                      "label").distinct()
    threat = table(spark, sf, "nation").select(F.concat(
        F.lit("en.src"), F.col("n_nationkey").cast("string"), F.lit("-example.com")).alias("d"))
    return ads, cmap, all_ads, threat


@query("campaign_table", f"""WITH {_CAMPAIGN}
SELECT category, attacks::BIGINT AS attacks, landing_domains, clusters, flagged_clusters, publishers
FROM per UNION ALL SELECT 'total', sum(attacks)::BIGINT, (SELECT count(DISTINCT landing) FROM land),
  sum(clusters)::BIGINT, sum(flagged_clusters)::BIGINT, (SELECT count(DISTINCT d) FROM (
    SELECT seed_domain AS d FROM pub UNION SELECT seed_domain FROM alone)) FROM per""")
def campaign_table(spark, sf):
    return campaigns.campaign_table(*_campaign_inputs(spark, sf))


@query("ad_summaries", f"""WITH {I.PAGE_ADS}, {I.domains_sql('SELECT home_url AS url FROM pa')}
SELECT screenshot_hash, count(*) AS ads,
  count(DISTINCT regexp_extract(ad_url, '^[a-z]+://([^/?#]*)', 1)) AS landing_hosts,
  count(DISTINCT domain) AS home_domains,
  count(DISTINCT regexp_extract(home_url, '^[a-z]+://([^/?#]*)', 1)) AS seed_domains
FROM pa JOIN dom ON host = {I.host_sql('home_url')} GROUP BY 1""")
def ad_summaries(spark, sf):
    ads = I.page_ads(spark, sf)
    seeds = ads.select("log_id", F.col("home_url").alias("seed_url"))
    return campaigns.ad_summaries(campaigns.with_seed(ads, seeds), I.suffix_rules(spark))


@query("flagged_landing_domains", """
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS fqdn, count(*) AS pages,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN (SELECT
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) FROM pages WHERE url LIKE '%utm_source=%')
  AS listed FROM pages GROUP BY ALL""")
def flagged_landing_domains(spark, sf):
    pages = table(spark, sf, "pages").select(urls.fqdn("url").alias("fqdn"), "url")
    threat = pages.where(F.col("url").contains("utm_source=")).select("fqdn")
    return campaigns.listed(pages.groupBy("fqdn").agg(F.count(F.lit(1)).alias("pages")),
                            threat, "fqdn")


@query("category_share", """
WITH c AS (SELECT lang AS name, count(*) AS n FROM documents JOIN labels USING (doc_id)
  WHERE lang <> 'de' GROUP BY 1)
SELECT name, n, round(n * 100.0 / (SELECT sum(n) FROM c), 2)::DOUBLE AS percent FROM c
ORDER BY n DESC, name LIMIT 20""")
def category_share(spark, sf):
    cats = table(spark, sf, "documents").select(
        F.col("doc_id").alias("domain"), F.col("lang").alias("name"))
    pubs = table(spark, sf, "labels").select(F.col("doc_id").alias("domain"))
    return campaigns.category_share(pubs, cats, ignore="de")


_TIERS = (950, 1000, 1100, 1500, 2100, 3000)


@query("popularity_tiers", f"""
WITH j AS (SELECT p_retailprice AS rank FROM lineitem LEFT JOIN part ON l_suppkey * 3 = p_partkey
  AND p_size > 10)
SELECT tier::BIGINT AS tier, (SELECT count(*) FROM j WHERE rank < tier) AS publishers,
  (SELECT count(*) FROM j WHERE rank IS NULL) AS unranked
FROM (VALUES {", ".join(f"({t})" for t in _TIERS)}) t(tier)""")
def popularity_tiers(spark, sf):
    pubs = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 3).alias("domain"))
    ranks = table(spark, sf, "part").where("p_size > 10").select(
        F.col("p_partkey").alias("domain"), F.col("p_retailprice").alias("rank"))
    return campaigns.popularity_tiers(pubs, ranks, tiers=_TIERS)


@query("rank_lists", """
WITH r AS (SELECT p_partkey AS d, p_size AS rank FROM part)
SELECT 'se_ad_pub_rank_list' AS list, rank FROM orders JOIN r ON o_custkey = d
UNION ALL SELECT 'all_pub_rank_list', rank FROM supplier JOIN r ON s_suppkey = d""")
def rank_lists(spark, sf):
    ranks = table(spark, sf, "part").select(F.col("p_partkey").alias("domain"),
                                            F.col("p_size").alias("rank"))
    return campaigns.rank_lists(
        table(spark, sf, "orders").select(F.col("o_custkey").alias("domain")),
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("domain")), ranks)


@query("category_lookup", """
SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS misses FROM documents d
LEFT JOIN labels l USING (doc_id)""")
def category_lookup(spark, sf):
    return campaigns.lookup(table(spark, sf, "documents").select("doc_id"),
                            table(spark, sf, "labels"), "doc_id")[1]


@query("category_names", """
SELECT doc_id % 300 AS domain, arg_max(lang || ',' || source, doc_id) AS names FROM documents
WHERE doc_id % 7 > 1 GROUP BY 1""")
def category_names(spark, sf):
    named = F.transform(F.array("lang", "source"), lambda x: F.struct(x.alias("name")))
    # lookups without a category, and failed ones
    found = F.when(F.col("doc_id") % 7 == 0, F.filter(named, lambda x: F.lit(False))).when(
        F.col("doc_id") % 7 > 1, named)
    df = table(spark, sf, "documents").select(
        (F.col("doc_id") % 300).alias("domain"), found.alias("category"),
        F.col("doc_id").alias("line_no"))
    return campaigns.category_names(campaigns.categorised(df)).withColumn(
        "names", F.array_join("names", ","))


@query("home_sets", """
SELECT DISTINCT source AS screenshot_hash, lang AS v FROM documents UNION
SELECT DISTINCT source, 'len' || (n_chars // 1000) FROM documents""")
def home_sets(spark, sf):

    df = table(spark, sf, "documents").select(
        F.col("source").alias("screenshot_hash"),
        F.array("lang", F.concat(F.lit("len"), F.floor(F.col("n_chars") / 1000).cast("string")))
        .alias("v"))
    return tracking.union_sets(df, "screenshot_hash", "v")
