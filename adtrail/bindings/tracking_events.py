"""Queries: reputation tables, polling jobs, records, chains, job lists, elements, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adtrail import fixed
from adtrail.bindings import inputs as I
from adtrail.bindings.inputs import shown, shown_sql, table
from adtrail.bindings.registry import query
from adtrail.functions import fields as fx, urls
from adtrail.operators import chains, elements, jobs, records, reputation, tracking
from adtrail.plans.cut import materialise, scratch_path, spread
from adtrail.plans.groups import ordered
from adtrail.sources import files, logs
from adtrail.streaming import streams


# --- reputation ----------------------------------------------------------------------------
@query("url_counts", f"""WITH {I.OBSERVATIONS} SELECT domain, url_path, campaign, count(*) AS count,
  arg_max(url, ts) AS url, arg_min(class, ts) AS class FROM obs GROUP BY 1, 2, 3""")
def url_counts(spark, sf):
    return reputation.url_counts(reputation.split_observations(I.observations(spark, sf)))


@query("seen_spans", f"""WITH {I.OBSERVATIONS} SELECT domain, campaign,
  {shown_sql('min(ts)')} AS first_seen, {shown_sql('max(ts)')} AS last_seen FROM obs GROUP BY 1, 2""")
def seen_spans(spark, sf):
    df = reputation.seen_spans(reputation.split_observations(I.observations(spark, sf)))
    return df.withColumns({c: shown(c) for c in ("first_seen", "last_seen")})


@query("campaigns_seen", f"""WITH {I.OBSERVATIONS} SELECT campaign,
  {shown_sql('max(ts)')} AS last_seen FROM obs GROUP BY 1""")
def campaigns_seen(spark, sf):
    return reputation.campaigns_seen(I.observations(spark, sf)).withColumn(
        "last_seen", shown("last_seen"))


@query("domain_slds", f"""WITH {I.OBSERVATIONS}, {I.domains_sql('SELECT url FROM obs')}
SELECT domain AS sld, host AS domain FROM dom""")
def domain_slds(spark, sf):
    return reputation.domain_slds(reputation.split_observations(I.observations(spark, sf)),
                                  I.suffix_rules(spark))


_TIMES = ("first_query_time", "last_query_time")


@query("verdict_state", f"""WITH {I.VERDICTS} SELECT * REPLACE (
  {shown_sql('first_query_time')} AS first_query_time, {shown_sql('last_query_time')}
  AS last_query_time) FROM verdicts""")
def verdict_state(spark, sf):
    return reputation.verdict_state(I.verdict_log(spark, sf)).withColumns(
        {c: shown(c) for c in _TIMES})


@query("verdict_counts", f"""WITH {I.VERDICTS} SELECT count(*) AS domains,
  count(*) FILTER (WHERE first_flag) AS flagged_at_first FROM verdicts""")
def verdict_counts(spark, sf):
    return reputation.verdict_counts(reputation.verdict_state(I.verdict_log(spark, sf)))


@query("verdict_flags", f"""WITH {I.VERDICTS} SELECT flag, se_flag, txt AS text, count(*) AS n
FROM vf GROUP BY 1, 2, 3""")
def verdict_flags(spark, sf):
    return I.verdict_log(spark, sf).select(fx.verdict_flags("result").alias("v")).groupBy(
        "v.flag", "v.se_flag", "v.text").agg(F.count(F.lit(1)).alias("n"))


@query("queryable_domains", f"""WITH {I.VERDICTS}, d AS (SELECT 'd' || c_custkey AS domain FROM customer)
SELECT domain FROM d LEFT JOIN verdicts USING (domain) WHERE last_flag IS NOT TRUE""")
def queryable_domains(spark, sf):
    known = table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("domain"))
    return reputation.queryable(
        reputation.verdict_table(known, I.verdict_log(spark, sf))).select("domain")


@query("not_in_flagged", f"""WITH {I.VERDICTS}, d AS (SELECT 'd' || c_custkey AS domain FROM customer)
SELECT domain FROM d WHERE domain NOT IN (SELECT domain FROM verdicts WHERE last_flag)""")
def not_in_flagged(spark, sf):
    known = table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("domain"))
    bad = reputation.verdict_state(I.verdict_log(spark, sf)).where("last_flag")
    return reputation.not_in(known, "domain", bad, "domain")


_SEEN = I.VERDICTS + """, seen AS (SELECT DISTINCT event_type AS campaign,
    'x' || user_id || '.com' AS domain FROM ev), slds AS (SELECT DISTINCT
    'x' || user_id || '.com' AS domain, 'd' || user_id AS sld FROM ev)"""


def _seen(spark, sf):
    e = I.events(spark, sf)
    user = F.col("user_id").cast("string")
    domain = F.concat(F.lit("x"), user, F.lit(".com")).alias("domain")
    return (e.select(F.col("event_type").alias("campaign"), domain).distinct(),
            e.select(domain, F.concat(F.lit("d"), user).alias("sld")).distinct())


@query("detected_per_campaign", f"""WITH {_SEEN} SELECT s.campaign, count(DISTINCT g.domain) AS detected
FROM seen s, slds l, verdicts g WHERE s.domain = l.domain AND l.sld = g.domain AND g.last_flag = true
GROUP BY s.campaign""")
def detected_per_campaign(spark, sf):
    return reputation.detected_per_campaign(
        *_seen(spark, sf), reputation.verdict_state(I.verdict_log(spark, sf)))


@query("queried_per_campaign", f"""WITH {_SEEN} SELECT s.campaign, count(DISTINCT g.domain) AS detected
FROM seen s, slds l, verdicts g WHERE s.domain = l.domain AND l.sld = g.domain GROUP BY s.campaign""")
def queried_per_campaign(spark, sf):
    return reputation.detected_per_campaign(
        *_seen(spark, sf), reputation.verdict_state(I.verdict_log(spark, sf)), flag=None)


@query("detected_like", f"""WITH {_SEEN} SELECT s.campaign, count(DISTINCT g.domain) AS detected
FROM seen s, slds l, verdicts g WHERE s.domain = l.domain AND l.sld = g.domain AND g.first_flag
AND s.campaign LIKE 'pur%' GROUP BY s.campaign""")
def detected_like(spark, sf):
    return reputation.detected_per_campaign(
        *_seen(spark, sf), reputation.verdict_state(I.verdict_log(spark, sf)),
        flag="first_flag", like="pur%")


@query("detection_lag", f"""WITH {I.VERDICTS} SELECT domain,
  epoch_us(last_query_time) - epoch_us(first_query_time) AS lag_us
FROM verdicts WHERE first_flag IS FALSE AND last_flag IS TRUE ORDER BY lag_us DESC, domain""")
def detection_lag(spark, sf):
    df = reputation.detection_lag(reputation.verdict_state(I.verdict_log(spark, sf)))
    parts = F.extract(F.lit("DAY"), "lag") * 86_400 + F.extract(F.lit("HOUR"), "lag") * 3_600 \
        + F.extract(F.lit("MINUTE"), "lag") * 60
    seconds = (F.extract(F.lit("SECOND"), "lag") * 1_000_000).cast("bigint")
    return df.select("domain", (parts.cast("bigint") * 1_000_000 + seconds).alias("lag_us"))


@query("detection_lag_stats", f"""WITH {I.VERDICTS}, l AS (SELECT
  epoch_us(last_query_time) - epoch_us(first_query_time) AS us FROM verdicts
  WHERE first_flag IS FALSE AND last_flag IS TRUE) SELECT count(*) AS domains,
  sum(us)::DOUBLE / count(us) / 1e6 AS mean_seconds, quantile_disc(us, 0.5) / 1e6 AS median_seconds
FROM l""")
def detection_lag_stats(spark, sf):
    return reputation.detection_lag_stats(reputation.verdict_state(I.verdict_log(spark, sf)))


@query("first_seen_files", f"""WITH {I.EVENTS} SELECT sha256(props) AS file_hash,
  {shown_sql('min(ts)')} AS first_seen FROM ev GROUP BY 1""")
def first_seen_files(spark, sf):
    df = I.events(spark, sf).select(F.sha2("props", 256).alias("file_hash"), "ts")
    return reputation.first_seen(df, ["file_hash"]).withColumn("first_seen", shown("first_seen"))


@query("ip_rows", f"""WITH {I.EVENTS} SELECT '10.0.' || (k % 20) || '.' || (user_id % 200) AS ip,
  event_type AS domain, {shown_sql('min(ts)')} AS first_seen FROM ev GROUP BY 1, 2""")
def ip_rows(spark, sf):
    answers = I.events(spark, sf).select(
        F.col("event_type").alias("domain"), "ts",
        F.concat(F.lit("alias.example.com.\n10.0."), (F.col("k") % 20).cast("string"), F.lit("."),
                 (F.col("user_id") % 200).cast("string"), F.lit("\n")).alias("answer"))
    return reputation.ip_rows(answers).withColumn("first_seen", shown("first_seen"))


@query("latest_by_key", f"""WITH {I.EVENTS} SELECT k, arg_max(event_type, ts) AS event_type FROM ev
GROUP BY 1""")
def latest_by_key(spark, sf):
    return reputation.latest_by_key(I.events(spark, sf), "k", "event_type", "ts")


@query("report_fields", f"""WITH {I.EVENTS} SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
  WHEN k % 4 = 0 THEN -1 ELSE k % 60 END AS positives, CASE WHEN event_type = 'error' THEN NULL
  WHEN k % 4 = 0 THEN -1 ELSE 60 END AS total FROM ev""")
def report_fields(spark, sf):
    k = F.col("k")
    json = F.when(F.col("event_type") != "error", F.concat(
        F.lit('{"response_code":'), F.when(k % 4 == 0, 0).otherwise(1).cast("string"),
        F.lit(',"positives":'), (k % 60).cast("string"), F.lit(',"total":60}')))
    return I.events(spark, sf).select("event_id", fx.report_fields(json).alias("r")).select(
        "event_id", "r.positives", "r.total")


@query("retry_set", """SELECT DISTINCT l_partkey AS file_hash FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def retry_set(spark, sf):
    seen = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file_hash"))
    reports = table(spark, sf, "part").select(
        F.col("p_partkey").alias("file_hash"), (F.col("p_size") - 26).alias("positives"))
    return reputation.retry_set(seen, reputation.reported(reports))


@query("next_hops", f"""WITH {I.EVENTS} SELECT event_id, CASE
  WHEN event_type IN ('click', 'view') AND k % 3 = 0 THEN 'http://to' || k || '.example.com/'
  WHEN event_type IN ('signup', 'error') AND k % 3 = 1 THEN 'http://meta' || k || '.example.com/'
  WHEN event_type = 'purchase' AND k % 3 = 1 THEN 'http://end' || k || '.example.com/' END AS hop
FROM ev""")
def next_hops(spark, sf):
    k = F.col("k").cast("string")
    status = F.when(F.col("k") % 3 == 0, 302).when(F.col("k") % 3 == 1, 200).otherwise(404)
    kind = F.when(F.col("event_type").isin("click", "view"), "redirect").when(
        F.col("event_type").isin("signup", "error"), "meta_refresh").otherwise(
        "multiple_nojs_redirects")

    def at(prefix: str):
        return F.concat(F.lit(f"http://{prefix}"), k, F.lit(".example.com/"))

    body = F.concat(F.lit('<html><meta content="0;url='), at("meta"), F.lit('"</html>'))
    return I.events(spark, sf).select("event_id", fx.next_hop(
        kind, status, F.create_map(F.lit("location"), at("to")), at("end"), body).alias("hop"))


# --- polling jobs --------------------------------------------------------------------------
@query("new_domain_jobs", f"""WITH {I.SOURCES} SELECT agent, url FROM att GROUP BY 1, 2
HAVING bool_or(landed NOT IN (SELECT d FROM ad_domains))""")
def new_domain_jobs(spark, sf):
    return tracking.keep_new_domain_jobs(
        I.attempts(spark, sf), I.sources(spark, sf)["ad_domains"], I.suffix_rules(spark))


_MATCH = I.SOURCES + f""", ih AS (SELECT DISTINCT image_hash AS h FROM att),
  near AS MATERIALIZED (SELECT ih.h, min({I.ham_sql('ih.h', 'known.h')}) AS bits FROM ih JOIN known
    ON {I.ham_sql('ih.h', 'known.h')} <= 13 GROUP BY 1)"""


@query("known_hash_jobs", f"""WITH {_MATCH} SELECT agent, url,
  CASE WHEN min(bits) = 0 THEN 'same' ELSE 'similar' END AS match
FROM att JOIN near ON near.h = image_hash GROUP BY 1, 2""")
def known_hash_jobs(spark, sf):
    hashes = I.document_hashes(spark, sf)
    return tracking.keep_known_hash_jobs(I.attempts(spark, sf, hashes),
                                         I.sources(spark, sf, hashes)["image_hashes"])


_DEDUPE = f""", sets AS (SELECT url, agent, CASE agent WHEN 'edge_win' THEN 0 WHEN 'chrome_mac' THEN 1
    WHEN 'ie_win' THEN 2 ELSE 3 END AS r, list_sort(list(DISTINCT loaded_url)) AS landing,
    list(DISTINCT image_hash) AS hashes FROM (SELECT * FROM att SEMI JOIN todo USING (agent, url))
    GROUP BY 1, 2),
  alike AS (SELECT x.url, x.r AS i, y.r AS j FROM sets x JOIN sets y ON x.url = y.url AND x.r < y.r
    AND x.landing = y.landing WHERE NOT EXISTS (SELECT 1 FROM
      (SELECT unnest(x.hashes) AS a) p, (SELECT unnest(y.hashes) AS b) q
      WHERE NOT list_contains(y.hashes, a) AND {I.ham_sql('a', 'b')} > 13)),
  k0 AS (SELECT url, r FROM sets WHERE r = 0),
  k1 AS (SELECT url, r FROM sets s WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM alike a JOIN k0
    ON k0.url = a.url AND k0.r = a.i WHERE a.url = s.url AND a.j = 1)),
  k2 AS (SELECT url, r FROM sets s WHERE r = 2 AND NOT EXISTS (SELECT 1 FROM alike a JOIN
    (SELECT * FROM k0 UNION ALL SELECT * FROM k1) k ON k.url = a.url AND k.r = a.i
    WHERE a.url = s.url AND a.j = 2)),
  k3 AS (SELECT url, r FROM sets s WHERE r = 3 AND NOT EXISTS (SELECT 1 FROM alike a JOIN
    (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) k
    ON k.url = a.url AND k.r = a.i WHERE a.url = s.url AND a.j = 3)),
  distinct_agents AS (SELECT agent, url FROM sets SEMI JOIN (SELECT * FROM k0 UNION ALL
    SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3) USING (url, r))"""


@query("dedupe_agents", f"""WITH {I.ATTEMPTS}, todo AS (SELECT DISTINCT agent, url FROM att) {_DEDUPE}
SELECT agent, url FROM distinct_agents""")
def dedupe_agents(spark, sf):
    return tracking.dedupe_agents(I.attempts(spark, sf))


@query("homogeneous_jobs", f"""WITH {I.ATTEMPTS}, h AS (SELECT DISTINCT agent, url, image_hash FROM att
  WHERE image_hash <> repeat('0', 32)), mixed AS (SELECT DISTINCT a.agent, a.url FROM h a JOIN h b
  ON a.agent = b.agent AND a.url = b.url AND {I.ham_sql('a.image_hash', 'b.image_hash')} > 13)
SELECT agent, url, (agent, url) NOT IN (SELECT (agent, url) FROM mixed) AS homogeneous
FROM (SELECT DISTINCT agent, url FROM att)""")
def homogeneous_jobs(spark, sf):
    return tracking.homogeneous_jobs(I.attempts(spark, sf))


# every (URL, agent) is expected but for URLs whose number is that of a nation
_FUNNEL = _MATCH + f""", new AS (SELECT agent, url FROM att GROUP BY 1, 2
    HAVING bool_or(landed NOT IN (SELECT d FROM ad_domains))),
  matched AS (SELECT DISTINCT agent, url FROM att JOIN near ON near.h = image_hash
    SEMI JOIN new USING (agent, url)),
  expected AS (SELECT agent, url FROM (SELECT DISTINCT agent, url, j FROM att)
    WHERE j NOT IN (SELECT n_nationkey FROM nation)),
  listed AS (SELECT agent, url FROM matched SEMI JOIN expected USING (agent, url)),
  todo AS (SELECT DISTINCT agent, url FROM att SEMI JOIN listed USING (agent, url)
    WHERE polled NOT IN (SELECT d FROM ups)) {_DEDUPE}"""


def _funnel(spark, sf):
    hashes = I.document_hashes(spark, sf)
    att = I.attempts(spark, sf, hashes)
    n = F.col("n_nationkey")
    skipped = table(spark, sf, "nation").select(F.concat(
        F.lit("http://m"), n.cast("string"), F.lit("-feed."), I.ending(n), F.lit("/go?x="),
        n.cast("string")).alias("url"))
    expected = jobs.minus(att.select("agent", "url").distinct(), skipped, ["url"])
    return (att, *tracking.milking_funnel(att, I.sources(spark, sf, hashes), expected, I.suffix_rules(spark)))


@query("milking_funnel", f"""WITH {_FUNNEL}
SELECT 0 AS stage, 'all' AS name, count(*) AS jobs FROM (SELECT DISTINCT agent, url FROM att)
UNION ALL SELECT 1, 'new_domain', count(*) FROM new
UNION ALL SELECT 2, 'known_hash', count(*) FROM matched
UNION ALL SELECT 3, 'expected', count(*) FROM listed
UNION ALL SELECT 4, 'not_upstream', count(*) FROM todo
UNION ALL SELECT 5, 'distinct_agent', count(*) FROM distinct_agents""")
def milking_funnel(spark, sf):
    return _funnel(spark, sf)[3]


@query("milk_sources", f"""WITH {_FUNNEL}, up AS (SELECT agent, url FROM matched
    ANTI JOIN todo USING (agent, url)), allrows AS (
    SELECT *, 'MILKING' AS category FROM att SEMI JOIN distinct_agents USING (agent, url)
    UNION ALL SELECT *, 'UPSTREAM' FROM att SEMI JOIN up USING (agent, url)),
  names AS (SELECT DISTINCT agent, url, category, agent || ':' || url_encode(url) AS job_name FROM allrows),
  hashes AS (SELECT DISTINCT agent, url, category, image_hash FROM allrows
    WHERE image_hash <> repeat('0', 32))
SELECT job_name, image_hash, category FROM names LEFT JOIN hashes USING (agent, url, category)""")
def milk_sources(spark, sf):
    att, kept, upstream, _ = _funnel(spark, sf)
    return tracking.milk_sources(att, kept, upstream)


@query("job_time", """SELECT sum(value::DECIMAL(18,2))::DOUBLE AS total, count(*) AS jobs,
  sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS mean FROM events""")
def job_time(spark, sf):
    df = table(spark, sf, "events").select(F.col("value").cast("decimal(18,2)").alias("total_time"))
    out = tracking.job_time(df).withColumn("total", F.col("total").cast("double"))
    return out.withColumn("mean", F.col("total") / F.col("jobs"))


@query("download_rate", f"""WITH {I.ATTEMPTS}, j AS (SELECT agent, url,
  count(*) FILTER (WHERE downloaded_files = 'True') AS w, count(*) AS n FROM att GROUP BY 1, 2)
SELECT sum(w)::BIGINT AS attempts_with_download, sum(n)::BIGINT AS attempts,
  count(*) FILTER (WHERE w = 0) AS jobs_without_download FROM j""")
def download_rate(spark, sf):
    return tracking.download_rate(I.attempts(spark, sf))


@query("find_hash", f"""WITH {I.ATTEMPTS}, probe AS (SELECT screenshot_hash AS p FROM dh
  ORDER BY doc_id LIMIT 1)
SELECT DISTINCT agent, url FROM att, probe WHERE {I.ham_sql('image_hash', 'p')} <= 40""")
def find_hash(spark, sf):
    hashes = I.document_hashes(spark, sf)
    probe = hashes.agg(F.min_by("screenshot_hash", "doc_id")).scalar()
    return tracking.find_hash(I.attempts(spark, sf, hashes), probe, 40)


_MILK = I.PAGE_ADS + f""", {I.domains_sql("""SELECT ad_url AS url FROM pa UNION SELECT hop1 FROM pa
    UNION SELECT hop2 FROM pa UNION SELECT home_url FROM pa""")},
  w AS MATERIALIZED (SELECT p, screenshot_hash, domain AS ad_domain, [hop1, hop2, home_url] AS hops
    FROM pa JOIN dom ON host = {I.host_sql('ad_url')}),
  oth AS MATERIALIZED (SELECT p, screenshot_hash, ad_domain, u, domain AS d, i,
    row_number() OVER (PARTITION BY p ORDER BY i) AS rn
    FROM (SELECT *, unnest(hops) AS u, generate_subscripts(hops, 1) AS i FROM w)
      JOIN dom ON host = {I.host_sql('u')} WHERE domain <> ad_domain),
  polled AS (SELECT p, u, d FROM oth WHERE rn = 1 AND screenshot_hash <> repeat('0', 32) AND d <> ''),
  firsts AS (SELECT d AS domain, arg_min(u, p) AS milking_url FROM polled GROUP BY 1),
  upd AS (SELECT DISTINCT d FROM oth WHERE rn > 1 OR screenshot_hash = repeat('0', 32))"""


def _milked(spark, sf):
    return tracking.milking_urls(I.page_ads(spark, sf), I.suffix_rules(spark), ["line_no"])


@query("milking_urls", f"WITH {_MILK} SELECT domain, milking_url FROM firsts")
def milking_urls(spark, sf):
    return _milked(spark, sf)["milking_urls"]


@query("upstream_domains", f"WITH {_MILK} SELECT d AS upstream_domain FROM upd")
def upstream_domains(spark, sf):
    return _milked(spark, sf)["upstream_domains"]


@query("milking_summary", f"""WITH {_MILK} SELECT
  (SELECT count(DISTINCT ad_domain) FROM w) AS ad_domains,
  (SELECT count(DISTINCT screenshot_hash) FROM w) AS image_hashes,
  (SELECT count(*) FROM firsts) AS milking_urls, (SELECT count(*) FROM upd) AS upstream_domains,
  (SELECT count(*) FROM (SELECT ad_domain FROM w UNION SELECT domain FROM firsts
    UNION SELECT d FROM upd)) AS all_domains""")
def milking_summary(spark, sf):
    return tracking.milking_summary(_milked(spark, sf))


# --- records -------------------------------------------------------------------------------
@query("adjacent_duplicates", f"""WITH {I.EVENTS}, l AS (SELECT event_id, event_type, k % 4 AS g,
  lag(event_type || (k % 4)) OVER (PARTITION BY user_id ORDER BY event_id) AS p, user_id FROM ev)
SELECT event_id, event_type, g FROM l WHERE p IS NULL OR p <> event_type || g""")
def adjacent_duplicates(spark, sf):
    df = I.events(spark, sf).select("event_id", "user_id", "event_type",
                                    (F.col("k") % 4).alias("g"))
    return records.drop_adjacent_duplicates(
        df, ["event_type", "g"], ["user_id"], ["event_id"]).select("event_id", "event_type", "g")


@query("enclosing_calls", f"""WITH {I.EVENTS}, m AS (SELECT user_id, event_id,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM ev),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM m),
f AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo FROM s),
v AS (SELECT *, s - least(lo, s) + CASE WHEN d < 0 AND s >= lo THEN 1 ELSE 0 END AS level FROM f)
SELECT event_id, level::INT AS level, last_value(CASE WHEN d > 0 THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id, level ORDER BY event_id) AS call FROM v""")
def enclosing_calls(spark, sf):
    df = I.events(spark, sf).select("user_id", "event_id", F.when(
        F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1)
        .otherwise(0).alias("delta"))
    return records.enclosing_calls(df, ["user_id"], ["event_id"], "delta").select(
        "event_id", "level", "call")


@query("paired_records", f"""WITH {I.EVENTS}, m AS (SELECT *,
  lag(event_type) OVER w AS before, lag(k) OVER w AS source FROM ev
  WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, source AS paired FROM m WHERE event_type = 'view' AND before = 'click'""")
def paired_records(spark, sf):
    kind = F.col("event_type")
    return records.pair_next(I.events(spark, sf), kind == "click", kind == "view", F.col("k"),
                             ["user_id"], ["event_id"]).select("event_id", "paired")


def _session_lines(spark, sf):
    """Session logs written from events: every click is a page URL, and so on."""
    k = F.col("k").cast("string")
    kind = F.col("event_type")
    line = F.when(kind == "click", F.concat(F.lit("t:3rd party page URL: http://l"), k, F.lit(".example.com/"))) \
        .when(kind == "view", F.concat(F.lit("t:Screenshot: of URL /s/shot"), k, F.lit(".png"))) \
        .when(kind == "signup", F.concat(F.lit(fixed.EVENT_LOG_MARKER + "log"), k, F.lit(".txt"))) \
        .when(kind == "purchase", F.lit("Downloaded a file: x")) \
        .otherwise(F.concat(F.lit("Home URL: http://h"), k, F.lit(".example.com/")))
    rows = I.events(spark, sf).select(
        F.col("user_id").cast("string").alias("log_id"), "event_id", line.alias("line"))
    return ordered(rows, ["log_id"], ["event_id"]).running_sum(F.lit(1).cast("long"), "line_no").result().select(
        "log_id", "line_no", "line")


# a click takes the two lines below it along, so a walk over each user's lines tells which clicks count
@query("session_ads", f"""WITH {I.EVENTS}, ln AS MATERIALIZED (SELECT *, row_number() OVER (
    PARTITION BY user_id ORDER BY event_id) AS line FROM ev),
  walk AS (WITH RECURSIVE w(user_id, line, free_at) AS (
    SELECT user_id, 0, 1 FROM ln WHERE line = 1
    UNION ALL SELECT w.user_id, w.line + 1, CASE WHEN ln.event_type = 'click' AND w.line + 1 >= w.free_at
      THEN w.line + 4 ELSE w.free_at END FROM w JOIN ln ON ln.user_id = w.user_id AND ln.line = w.line + 1)
    SELECT user_id, line, free_at, coalesce(lag(free_at) OVER (PARTITION BY user_id ORDER BY line), 1) AS before FROM w),
  free AS MATERIALIZED (SELECT ln.* FROM ln JOIN walk USING (user_id, line) WHERE line >= before),
  home AS (SELECT user_id, min(line) AS line, arg_min(k, line) AS hk FROM free WHERE event_type = 'view' GROUP BY 1),
  logs AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'log' || k || '.txt' END
    IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line) AS log FROM free)
SELECT p.user_id::VARCHAR AS log_id, p.line AS line_no, 'http://l' || p.k || '.example.com/' AS ad_url,
  'shot' || s.k || '.png' AS screenshot, p.log AS event_log,
  CASE WHEN home.line < p.line THEN '/s/shot' || hk || '.png' END AS home_url
FROM logs p JOIN ln s ON s.user_id = p.user_id AND s.line = p.line + 2 AND s.event_type = 'view'
LEFT JOIN home ON home.user_id = p.user_id WHERE p.event_type = 'click'""")
def session_ads(spark, sf):
    return records.session_ads(_session_lines(spark, sf)).drop("screenshot_path")


@query("session_outcome", f"""WITH {I.EVENTS} SELECT user_id::VARCHAR AS log_id,
  'http://h' || arg_max(k, event_id) FILTER (WHERE event_type = 'error') || '.example.com/' AS loaded_url,
  bool_or(event_type = 'purchase') AS downloaded_files FROM ev GROUP BY 1""")
def session_outcome(spark, sf):
    return records.session_outcome(_session_lines(spark, sf)).drop("screenshot_path")


@query("tagged_lines", f"""WITH {I.EVENTS} SELECT event_id FROM ev WHERE event_type = 'error'
AND k % 2 = 0""")
def tagged_lines(spark, sf):
    text = F.concat(F.when((F.col("event_type") == "error") & (F.col("k") % 2 == 0), "MALVERT")
                    .otherwise("plain"), F.lit(" line "), F.col("k").cast("string"))
    return records.tagged_lines(I.events(spark, sf).select("event_id", text.alias("line"))).select(
        "event_id")


def _record_text(spark, sf):
    """Event records as text, in the form the browser writes them."""
    k = F.col("k").cast("string")
    p = fixed.RECORD_PREFIX
    return spread(I.events(spark, sf)).select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit("\nLOG::Page::"), "event_type", F.lit(" :\n"),
                 F.lit(f"{p}frame="), k, F.lit(f"\n{p}note\n{p}frame=f"), k,
                 F.lit(f"\n{p}code=var a = "), k, F.lit(f";\nvar b;\n{p}arg_name=type\n{p}arg_value="),
                 "event_type", F.lit(f"\n{p}attr_name=\"id\"\n{p}attr_value=\"x"), k,
                 F.lit('"\n')).alias("value"))


@query("parse_records", f"""WITH {I.EVENTS} SELECT user_id::VARCHAR AS log_id, event_id AS seq,
  'LOG::Page::' || event_type || ' :' AS header, 'f' || k AS frame,
  'var a = ' || k || ';' || chr(10) || 'var b;' AS code, event_type AS type, 'x' || k AS attr_id,
  2 AS fields, false AS malformed FROM ev""")
def parse_records(spark, sf):
    df = logs.parse_records(_record_text(spark, sf))
    return df.select("log_id", "seq", "header", records.field("frame").alias("frame"),
                     records.field("code").alias("code"),
                     records.field("type", "args").alias("type"),
                     records.field("id", "attrs").alias("attr_id"),
                     F.size("fields").alias("fields"), "malformed")


@query("event_log_scan", f"""WITH {I.EVENTS} SELECT header, frame, count(*) AS n FROM (SELECT
  'LOG::Page::' || event_type || ' :' AS header, 'f' || k AS frame FROM ev) GROUP BY 1, 2""")
def event_log_scan(spark, sf):
    path = scratch_path(spark)
    _record_text(spark, sf).select("value").write.option(
        "lineSep", fixed.RECORD_END).text(path)
    return logs.read_event_log(spark, path).groupBy(
        "header", records.field("frame").alias("frame")).agg(F.count(F.lit(1)).alias("n"))


@query("downloads", f"""WITH {I.EVENTS} SELECT event_id AS seq, 'g' || k AS guid, k * 10::BIGINT AS total_bytes,
  k % 2 = 1 AS has_user_gesture, 'http://a' || k || '.example.com/ http://b.example.com/' AS urls
FROM ev WHERE event_type = 'purchase'""")
def downloads(spark, sf):
    k = F.col("k").cast("string")
    header = F.when(F.col("event_type") == "purchase", "DownloadManagerImpl::StartDownload"
                    ).otherwise("Other::Call")
    text = F.concat(F.lit("LOG::Forensics::"), header, F.lit(" :\n  guid=g"), k,
                    F.lit("\n  url=http://a"), k, F.lit(".example.com/\n  url=http://b.example.com/"),
                    F.lit("\n  total_bytes="), (F.col("k") * 10).cast("string"),
                    F.lit("\n  has_user_gesture="), (F.col("k") % 2).cast("string"), F.lit("\n"))
    rows = spread(I.events(spark, sf)).select(F.col("user_id").cast("string").alias("log_id"),
                                      F.col("event_id").alias("seq"), text.alias("value"))
    return records.downloads(logs.parse_records(rows, dialect="v1")).select(
        "seq", "guid", "total_bytes", "has_user_gesture", F.array_join("urls", " ").alias("urls"))


@query("bridge_calls", f"""WITH {I.EVENTS} SELECT event_id AS seq, 'OnInvokeMethod' AS call, k AS object_id,
  event_type AS method_name, '["' || k || '"]' AS method_args FROM ev""")
def bridge_calls(spark, sf):
    k = F.col("k").cast("string")
    text = F.concat(F.lit("LOG::Forensics::GinJavaBridgeDispatcherHost::OnInvokeMethod :"),
                    F.lit("\n  routing_id=1\n  object_id="), k, F.lit("\n  method_name="),
                    "event_type", F.lit('\n  method_args=::JSON::["'), k, F.lit('"]::JSON::\n'))
    rows = spread(I.events(spark, sf)).select(F.col("user_id").cast("string").alias("log_id"),
                                      F.col("event_id").alias("seq"), text.alias("value"))
    return records.bridge_calls(logs.parse_records(rows, dialect="v1")).select(
        "seq", "call", "object_id", "method_name", "method_args")


# --- chains --------------------------------------------------------------------------------
@query("frame_roots", f"""WITH {I.EVENTS}, p AS (SELECT user_id, event_id AS frame,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent, event_type FROM ev),
  r AS (SELECT user_id, frame, CASE WHEN event_type <> 'purchase' THEN parent END AS parent FROM p)
SELECT user_id::VARCHAR AS log_id, frame::VARCHAR AS frame, max(CASE WHEN parent IS NULL THEN frame END)
  OVER (PARTITION BY user_id ORDER BY frame)::VARCHAR AS root FROM r QUALIFY parent IS NOT NULL""")
def frame_roots(spark, sf):
    e = I.events(spark, sf).select(F.col("user_id").cast("string").alias("log_id"), "event_id",
                                   "event_type")
    g = ordered(e, ["log_id"], ["event_id"]).previous_row(F.col("event_id"), "_p")
    links = g.result().where("_p is not null and event_type <> 'purchase'").select(
        "log_id", F.col("event_id").cast("string").alias("frame"),
        F.col("_p.v").cast("string").alias("parent"), F.col("event_id").alias("seq"))
    return chains.frame_roots(links)


@query("current_runner", f"""WITH {I.BROWSER} SELECT user_id::VARCHAR AS log_id, seq,
  run_frame, run_url FROM be LEFT JOIN runner USING (user_id, seq) WHERE t = 'click'""")
def current_runner(spark, sf):
    ev = materialise(records.route_events(I.browser_events(spark, sf)).withColumn(
        "root", records.field("frame")))
    marks = chains.span_marks(ev).withColumn("root", F.col("frame"))
    asked = ev.where("route in ('js_navigation', 'set_attribute')").select(
        "log_id", "seq", F.array(records.field("frame"), records.field("main_frame"))
        .alias("frames"))
    none = spark.createDataFrame([], "log_id string, frame string, root string")
    return chains.current_runner(asked, marks, none).select(
        "log_id", "seq", F.col("runner.frame_id").alias("run_frame"),
        F.col("runner.value").alias("run_url"))


def _node_columns(name: str, out: str) -> list:
    return [F.col(f"{name}.{c}").alias(f"{out}_{c}") for c in ("frame_id", "kind", "value", "value2")]


@query("derive_edges", f"""WITH {I.PAGE_EVENTS} SELECT user_id::VARCHAR AS log_id, seq, df AS dst_frame_id,
  dk AS dst_kind, dv AS dst_value, d2 AS dst_value2, sf AS src_frame_id, sk AS src_kind, sv AS src_value,
  s2 AS src_value2, reason, policy FROM raw""")
def derive_edges(spark, sf):
    return chains.derive_edges(I.page_events(spark, sf)).select(
        "log_id", "seq", *_node_columns("dst", "dst"), *_node_columns("src", "src"), "reason", "policy")


@query("resolve_edges", f"""WITH {I.PAGE_EVENTS} SELECT user_id::VARCHAR AS log_id, df AS dst_frame_id,
  dk AS dst_kind, dv AS dst_value, d2 AS dst_value2, e.f AS src_frame_id, e.k AS src_kind, e.v AS src_value,
  e.v2 AS src_value2, e.why AS reason, born FROM resolved""")
def resolve_edges(spark, sf):
    return chains.resolve_edges(chains.derive_edges(I.page_events(spark, sf))).select(
        "log_id", *_node_columns("dst", "dst"), *_node_columns("src", "src"), "reason", "born")


@query("load_urls", f"""WITH {I.PAGE_EVENTS} SELECT user_id::VARCHAR AS log_id, arg_min(n_url, seq) AS load_url
FROM pe WHERE w = 'load' GROUP BY 1""")
def load_urls(spark, sf):
    return chains.load_urls(I.page_events(spark, sf))


# the walk over one URL node per step: stops at a repeat, at the load URL or at the limit
_WALK = I.STEPS + """, targets AS (SELECT DISTINCT dst_url AS ad_url, log_id FROM edges
    WHERE reason = 'purchase'), home AS (SELECT log_id, arg_min(src_url, seq) AS load_url FROM edges
    GROUP BY 1),
  walk AS (WITH RECURSIVE w(log_id, ad_url, load_url, key, hop, path, reasons, going) AS (
    SELECT log_id, ad_url, {load}, ad_url, 0, []::VARCHAR[], []::VARCHAR[], true
      FROM targets JOIN home USING (log_id)
    UNION ALL SELECT w.log_id, w.ad_url, w.load_url, e.src_url, w.hop + 1,
      list_append(w.path, w.key), list_append(w.reasons, e.reason),
      e.src_url <> coalesce(w.load_url, '') AND ({limit} OR w.hop + 1 < 30)
      FROM w JOIN edges e ON e.log_id = w.log_id AND e.dst_url = w.key
      WHERE w.going AND NOT list_contains(w.path, w.key))
    SELECT * FROM w)
SELECT log_id, ad_url, array_to_string(list_append(path, key), ' ') AS nodes,
  array_to_string(list_append(reasons, '{last}'), ' ') AS reasons FROM walk
QUALIFY row_number() OVER (PARTITION BY log_id, ad_url ORDER BY hop DESC) = 1"""


def _shown_chain(df: DataFrame) -> DataFrame:
    return df.select(
        "log_id", "ad_url",
        F.array_join(F.transform("chain", lambda h: h["node"]["value"]), " ").alias("nodes"),
        F.array_join(F.transform("chain", lambda h: h["reason"]), " ").alias("reasons"))


def _step_targets(spark, sf, with_home: bool):
    steps = materialise(I.steps(spark, sf).where("dst_url <> src_url"))
    kept = steps.groupBy("log_id", "dst_url").agg(F.min_by("reason", "seq").alias("reason"))
    targets = kept.where("reason = 'purchase'").select("log_id", F.col("dst_url").alias("ad_url"))
    if with_home:
        home = steps.groupBy("log_id").agg(F.min_by("src_url", "seq").alias("load_url"))
        targets = targets.join(home, "log_id")
    return steps, targets


@query("redirect_chains", "WITH " + _WALK.format(load="load_url", limit="false", last="FIRST"))
def redirect_chains(spark, sf):
    steps, targets = _step_targets(spark, sf, True)
    node = [fx.node(F.lit(""), F.lit("URL"), F.col(c)).alias(n)
            for c, n in (("dst_url", "dst"), ("src_url", "src"))]
    edges = chains.valid_edges(steps.select("log_id", *node, "reason", "seq",
                                            F.lit(chains.FIRST_WINS).alias("policy")))
    return _shown_chain(chains.redirect_chains(chains.resolve_edges(edges), targets))


@query("url_chains", "WITH " + _WALK.format(load="NULL::VARCHAR", limit="true", last=""))
def url_chains(spark, sf):
    steps, targets = _step_targets(spark, sf, False)
    return _shown_chain(chains.url_chains(steps, targets))


# from every navigation's URL back over resolved edges; a listener without an edge of its own frame
# takes the earliest of any frame
@query("chains_from_events", f"""WITH {I.PAGE_EVENTS},
  home AS (SELECT user_id, arg_min(n_url, seq) AS load_url FROM pe WHERE w = 'load' GROUP BY 1),
  loose AS (SELECT user_id, dv, d2, arg_min(e, born) AS e FROM resolved WHERE dk = 'event_listener' GROUP BY 1, 2, 3),
  nodes AS MATERIALIZED (SELECT r.user_id, r.df, r.dk, r.dv, r.d2, r.born, r.e.f AS sf, r.e.k AS sk, r.e.v AS sv,
    r.e.v2 AS s2, r.e.why AS why FROM resolved r),
  steps AS MATERIALIZED (SELECT s.user_id, s.sf AS df, s.sk AS dk, s.sv AS dv, s.s2 AS d2,
      coalesce(n.sf, l.e.f) AS sf, coalesce(n.sk, l.e.k) AS sk, coalesce(n.sv, l.e.v) AS sv,
      CASE WHEN n.sk IS NOT NULL THEN n.s2 ELSE l.e.v2 END AS s2, coalesce(n.why, l.e.why) AS why
    FROM (SELECT DISTINCT user_id, sf, sk, sv, s2 FROM nodes) s
      LEFT JOIN nodes n ON n.user_id = s.user_id AND n.df = s.sf AND n.dk = s.sk AND n.dv = s.sv
        AND n.d2 IS NOT DISTINCT FROM s.s2
      LEFT JOIN loose l ON l.user_id = s.user_id AND s.sk = 'event_listener' AND l.dv = s.sv AND l.d2 = s.s2
    WHERE n.sk IS NOT NULL OR l.e IS NOT NULL),
  starts AS (SELECT user_id, dv AS ad_url, load_url, df, dk, dv, d2, sf, sk, sv, s2, why FROM nodes
    LEFT JOIN home USING (user_id) WHERE dk = 'URL'
      AND (user_id, dv) IN (SELECT (user_id, n_url) FROM pe WHERE w = 'nav')
    QUALIFY row_number() OVER (PARTITION BY user_id, dv ORDER BY born) = 1),
  walk AS (WITH RECURSIVE w(user_id, ad_url, load_url, hop, frame, kind, value, value2, reason, nf, nk, nv, n2,
      seen, going) AS (
    SELECT user_id, ad_url, load_url, 0, df, dk, dv, d2, why, sf, sk, sv, s2, [(df, dk, dv, d2, why)::VARCHAR],
      NOT (sk = 'URL' AND sv = coalesce(load_url, '')) FROM starts
    UNION ALL SELECT w.user_id, w.ad_url, w.load_url, w.hop + 1, w.nf, w.nk, w.nv, w.n2, s.why, s.sf, s.sk, s.sv, s.s2,
      list_append(w.seen, (w.nf, w.nk, w.nv, w.n2, s.why)::VARCHAR),
      NOT (s.sk = 'URL' AND s.sv = coalesce(w.load_url, '')) AND w.hop + 2 < 30
      FROM w JOIN steps s ON s.user_id = w.user_id AND s.df = w.nf AND s.dk = w.nk AND s.dv = w.nv
        AND s.d2 IS NOT DISTINCT FROM w.n2
      WHERE w.going AND NOT list_contains(w.seen, (w.nf, w.nk, w.nv, w.n2, s.why)::VARCHAR))
    SELECT * FROM w)
SELECT user_id::VARCHAR AS log_id, ad_url, hop, frame, kind, value, reason FROM walk
UNION ALL SELECT user_id::VARCHAR, ad_url, hop + 1, nf, nk, nv, 'FIRST' FROM walk
QUALIFY row_number() OVER (PARTITION BY user_id, ad_url ORDER BY hop DESC) = 1""")
def chains_from_events(spark, sf):
    """Event records all the way to chains, with the session's load URL from its own records."""
    ev = I.page_events(spark, sf)
    edges = materialise(chains.resolve_edges(chains.derive_edges(ev)))
    targets = ev.where(F.col("header").contains("WillNavigateFrame")).select(
        "log_id", records.field("url").alias("ad_url")).distinct().join(chains.load_urls(ev), "log_id", "left")
    found = chains.redirect_chains(edges, targets)
    return chains.chain_rows(found).select(
        "log_id", "ad_url", "hop", F.col("node.frame_id").alias("frame"), F.col("node.kind").alias("kind"),
        F.col("node.value").alias("value"), "reason")


# --- seeds and jobs ------------------------------------------------------------------------
def _seeds(spark, sf):
    rank = F.when(F.col("p_size") > 45, fixed.UNRANKED).otherwise(
        (F.col("p_retailprice") * 10).cast("int").cast("string"))
    lines = table(spark, sf, "part").select(
        F.concat("p_name", F.lit("-"), (F.col("p_partkey") % 500).cast("string"), F.lit(";"), rank)
        .alias("value"), F.col("p_brand").alias("list"))
    return files.parse_seeds(lines)


_SEEDS = """seeds AS (SELECT DISTINCT p_name || '-' || (p_partkey % 500) AS domain,
    CASE WHEN p_size > 45 THEN 30000000 ELSE CAST(trunc(p_retailprice * 10) AS INT) END AS rank,
    p_brand AS list FROM part)"""


@query("parse_seeds", f"WITH {_SEEDS} SELECT domain, rank, list FROM seeds")
def parse_seeds(spark, sf):
    return _seeds(spark, sf)


@query("popularity_ranks", f"WITH {_SEEDS} SELECT domain, min(rank) AS rank FROM seeds GROUP BY 1")
def popularity_ranks(spark, sf):
    return jobs.popularity_ranks(_seeds(spark, sf))


@query("split_vantage", f"""WITH {_SEEDS} SELECT domain, rank FROM seeds EXCEPT
SELECT domain, rank FROM seeds WHERE list IN ('Brand#1', 'Brand#2')""")
def split_vantage(spark, sf):
    return jobs.split_vantage(_seeds(spark, sf), ["Brand#1", "Brand#2"])[1]


@query("by_rank", f"WITH {_SEEDS} SELECT domain, rank FROM (SELECT DISTINCT domain, rank FROM seeds)")
def by_rank(spark, sf):
    return jobs.by_rank(_seeds(spark, sf).select("domain", "rank").distinct())


_BLOCKS = _SEEDS + """, ranked AS (SELECT domain, rank, (row_number() OVER (ORDER BY rank, domain) - 1)
    // 100 AS block FROM (SELECT domain, min(rank) AS rank FROM seeds GROUP BY 1))"""


@query("rank_blocks", f"WITH {_BLOCKS} SELECT domain, rank, block FROM ranked")
def rank_blocks(spark, sf):
    return jobs.blocks(jobs.popularity_ranks(_seeds(spark, sf)), ["rank", "domain"])


_AGENTS = ", ".join(f"('{a}')" for a in fixed.AGENT_PREFERENCE)


@query("crawl_jobs", f"""WITH {_BLOCKS} SELECT block, agent || ':' || domain AS job FROM ranked,
  (VALUES {_AGENTS}) t(agent)""")
def crawl_jobs(spark, sf):
    seeds = jobs.blocks(jobs.popularity_ranks(_seeds(spark, sf)), ["rank", "domain"])
    matrix = jobs.job_matrix(seeds.withColumn("url", F.struct("domain", "block")),
                             fixed.AGENT_PREFERENCE)
    return jobs.shuffle_in_blocks(matrix.select(
        F.col("url.block").alias("block"),
        F.concat_ws(":", "agent", "url.domain").alias("job")))


@query("pilot_jobs", f"""SELECT agent, page_id AS url, i AS attempt FROM pages,
  (VALUES {_AGENTS}) t(agent), range(1, 6) r(i)""")
def pilot_jobs(spark, sf):
    return jobs.job_matrix(table(spark, sf, "pages"), fixed.AGENT_PREFERENCE, fixed.PILOT_REPEATS,
                           url="page_id")


@query("split_round_robin", """SELECT s_suppkey, ((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1)
  % 7)::INT AS part FROM supplier""")
def split_round_robin(spark, sf):
    return files.split_round_robin(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), 7,
                                   ["s_acctbal", "s_suppkey"]).select("s_suppkey", "part")


@query("uncategorised_publishers", """SELECT DISTINCT source FROM documents WHERE source NOT IN (
  SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def uncategorised_publishers(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    done = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return jobs.minus(docs.select("source").distinct(), done, ["source"])


@query("sample_domains", """SELECT c_name FROM (SELECT DISTINCT c_name FROM customer)
ORDER BY md5('0|' || c_name), c_name LIMIT 10""")
def sample_domains(spark, sf):
    return jobs.sample_k(table(spark, sf, "customer"), "c_name", 10)


@query("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top_k(spark, sf):
    return jobs.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"),
                      [F.desc("p_retailprice"), "p_partkey"], 20)


@query("publisher_coverage", """WITH b AS (SELECT user_id AS d, value::DECIMAL(18,2) AS t,
  event_type = 'click' AS r FROM events) SELECT count(DISTINCT d) FILTER (WHERE r) AS residential,
  count(DISTINCT d) FILTER (WHERE NOT r) AS non_residential, count(DISTINCT d) AS publishers,
  sum(t)::DOUBLE / count(t) AS mean_time FROM b""")
def publisher_coverage(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("domain"), F.round(F.col("value") * 100).cast("bigint")
        .alias("total_time"), "event_type")
    out = jobs.publisher_coverage(e.where("event_type = 'click'"), e.where("event_type <> 'click'"))
    totals = e.agg((F.sum("total_time") / 100.0).alias("s"), F.count("total_time").alias("c"))
    return out.withColumn("mean_time", totals.select(F.col("s") / F.col("c")).scalar())


# --- elements ------------------------------------------------------------------------------
_ORDER = "(preferred AND h * w > 100) DESC, h * w DESC, elem_id"


@query("rank_elements", f"""WITH {I.ELEMENTS} SELECT page_id, position, elem_id FROM (SELECT *,
  row_number() OVER (PARTITION BY page_id ORDER BY {_ORDER}) AS position FROM el) WHERE position <= 3""")
def rank_elements(spark, sf):
    return elements.rank_elements(I.elements(spark, sf), 3, 100).select(
        "page_id", "position", "elem_id")


@query("diverse_elements", f"""WITH RECURSIVE {I.ELEMENTS}, ord AS MATERIALIZED (SELECT *,
    floor(mid_x / 100) AS cx, floor(mid_y / 100) AS cy, row_number() OVER (PARTITION BY page_id
    ORDER BY {_ORDER}) AS rn FROM el),
  go(page_id, rn, kept) AS (SELECT page_id, 0::BIGINT, []::STRUCT(elem_id BIGINT, w DOUBLE, h DOUBLE,
      cx DOUBLE, cy DOUBLE, y DOUBLE)[] FROM (SELECT DISTINCT page_id FROM ord)
    UNION ALL SELECT g.page_id, o.rn, CASE WHEN len(g.kept) >= 20
      OR len(list_filter(g.kept, lambda x: x.w = o.w AND x.h = o.h)) > 0
      OR len(list_filter(g.kept, lambda x: x.cx = o.cx AND x.cy = o.cy)) > 0
      OR len(list_filter(g.kept, lambda x: x.y = o.mid_y)) >= 2 THEN g.kept
      ELSE list_append(g.kept, {{'elem_id': o.elem_id, 'w': o.w, 'h': o.h, 'cx': o.cx, 'cy': o.cy,
        'y': o.mid_y}}) END FROM go g JOIN ord o ON o.page_id = g.page_id AND o.rn = g.rn + 1),
  last AS (SELECT page_id, arg_max(kept, rn) AS kept FROM go GROUP BY 1)
SELECT page_id, generate_subscripts(kept, 1) AS position, unnest(kept).elem_id AS elem_id FROM last""")
def diverse_elements(spark, sf):
    return elements.diverse_elements(I.elements(spark, sf), pref_area=100).select(
        "page_id", "position", "elem_id")


@query("element_flags", """SELECT l_orderkey, l_linenumber, l_quantity * (l_linenumber + 1) AS area,
  l_quantity <> 0 AND l_partkey % 900 < 700 AND l_suppkey < 300 AND l_suppkey > 0
  AND l_partkey % 900 > 0 AS visible, floor(l_partkey / 100.0) * 100 AS cell, l_suppkey, l_partkey
FROM lineitem""")
def element_flags(spark, sf):
    y = F.col("l_partkey") % 900
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", fx.element_area("l_quantity", F.col("l_linenumber") + 1)
        .alias("area"), fx.in_viewport("l_suppkey", y, "l_quantity", F.col("l_linenumber") + 1,
                                       F.lit(700), F.lit(300)).alias("visible"),
        fx.round_down("l_partkey", 100).alias("cell"), "l_suppkey", "l_partkey")


# --- streams -------------------------------------------------------------------------------
def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        sf).withColumns({"k": F.get_json_object("props", "$.k").cast("int"),
                         "ts": F.col("ts").cast("timestamp")})


@query("first_seen_stream", f"WITH {I.EVENTS} SELECT DISTINCT user_id FROM ev")
def first_seen_stream(spark, sf):
    seen = streams.first_seen_stream(_event_stream(spark, sf).select("user_id"), ["user_id"])
    return streams.run_available(seen)


@query("ingest_stream", f"""WITH {I.EVENTS} SELECT event_type AS ip_type, count(*) AS n FROM ev
WHERE k % 10 <> 3 GROUP BY 1""")
def ingest_stream(spark, sf):
    rows = _event_stream(spark, sf).select(
        "event_id", F.col("event_type").alias("ip_type"),
        F.when(F.col("k") % 10 != 3, F.col("props")).alias("job_name"))
    done = streams.run_available(streams.ingest_results(rows, ["job_name", "ip_type"]),
                                 partition="ip_type")
    return done.groupBy("ip_type").agg(F.count(F.lit(1)).alias("n"))


@query("observe_stream", f"""WITH {I.EVENTS} SELECT user_id, event_type, count(*) AS count,
  {shown_sql('min(ts)')} AS first_seen, {shown_sql('max(ts)')} AS last_seen FROM ev GROUP BY 1, 2""")
def observe_stream(spark, sf):
    out = streams.observe_stream(_event_stream(spark, sf), ["user_id", "event_type"])
    return streams.run_updates(out, ["user_id", "event_type"]).withColumns(
        {c: shown(c) for c in ("first_seen", "last_seen")})


@query("verdict_stream", f"""WITH {I.VERDICTS} SELECT domain, {shown_sql('first_query_time')}
  AS first_query_time, {shown_sql('last_query_time')} AS last_query_time, first_flag, last_flag,
  last_result FROM verdicts""")
def verdict_stream(spark, sf):
    e = _event_stream(spark, sf)
    answers = e.select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"),
        F.col("ts").alias("query_time"), I.verdict_text().alias("result"))
    out = streams.run_updates(streams.verdict_stream(answers), ["domain"],
                              finish=reputation.unpack_verdicts)
    return out.withColumns({c: shown(c) for c in _TIMES}).select(
        "domain", *_TIMES, "first_flag", "last_flag", "last_result")


@query("closed_sessions", f"""WITH {I.EVENTS}, g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w
    < INTERVAL 300 SECONDS THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts) AS n FROM g),
  c AS (SELECT event_type, min(ts) AS started, max(ts) + INTERVAL 300 SECONDS AS quiet_at,
    count(*) AS lines FROM s GROUP BY event_type, n)
SELECT event_type, {shown_sql('started')} AS started, {shown_sql('quiet_at')} AS quiet_at, lines FROM c
WHERE quiet_at <= (SELECT date_trunc('millisecond', max(ts)) FROM ev)""")
def closed_sessions(spark, sf):
    out = streams.run_available(streams.closed_sessions(_event_stream(spark, sf), "event_type"))
    return out.withColumns({c: shown(c) for c in ("started", "quiet_at")})


@query("tagged_stream", """SELECT event_id FROM events WHERE event_type LIKE '%err%'""")
def tagged_stream(spark, sf):
    lines = _event_stream(spark, sf).select("event_id", F.col("event_type").alias("line"))
    return streams.run_available(streams.tagged_stream(lines, "err")).select("event_id")


@query("insert_absent_stream", f"""WITH {I.EVENTS} SELECT k, {shown_sql('min(ts)')} AS first_seen FROM ev
GROUP BY 1""")
def insert_absent_stream(spark, sf):
    out = streams.insert_absent_stream(_event_stream(spark, sf), ["k"])
    return streams.run_updates(out, ["k"]).withColumn("first_seen", shown("first_seen"))


# --- sources and sinks ---------------------------------------------------------------------
@query("ad_file_round_trip", f"""WITH {I.PAGE_ADS} SELECT p::VARCHAR AS log_id, ad_url, home_url,
  screenshot_hash, 5 AS hops, hop2, 'click' AS listener FROM pa""")
def ad_file_round_trip(spark, sf):
    path = scratch_path(spark)
    ads = I.page_ads(spark, sf).withColumns({
        "screenshot": F.lit(None).cast("string"), "event_log": F.lit("log \"x\"")})
    files.write_ads(ads, path)
    return files.read_ads(spark, path).select(
        "log_id", "ad_url", "home_url", "screenshot_hash", F.size("redirections").alias("hops"),
        F.col("redirections")[3]["value"].alias("hop2"),
        F.col("redirections")[2]["value2"].alias("listener"))


@query("dict_round_trip", """SELECT source AS key, lang AS value FROM documents GROUP BY 1, 2""")
def dict_round_trip(spark, sf):
    pairs = table(spark, sf, "documents").select("source", "lang").distinct()
    return files.parse_dict(files.dict_json(pairs, "source", "lang"), "array<string>")


@query("job_list", f"""WITH {I.EVENTS} SELECT DISTINCT 'd' || k || '.com' AS domain FROM ev""")
def job_list(spark, sf):
    lines = I.events(spark, sf).select(F.concat(
        "event_type", F.lit(":d"), F.col("k").cast("string"), F.lit(".com ")).alias("value"))
    return files.job_domains(lines)


@query("session_ids", f"""WITH {I.EVENTS} SELECT event_id, 'h' || user_id || '_c_' ||
  epoch_us(ts)::VARCHAR AS log_id FROM ev""")
def session_ids(spark, sf):
    return I.events(spark, sf).select("event_id", fx.session_id(
        F.concat(F.lit("h"), F.col("user_id").cast("string")), F.lit("c"), "ts").alias("log_id"))


@query("payloads", f"""WITH {I.EVENTS} SELECT event_id, event_type AS json, k || ' (1,2) run' AS fn,
  'http://x/' || k AS token FROM ev""")
def payloads(spark, sf):
    k = F.col("k").cast("string")
    json = F.concat(F.lit('::JSON::"'), "event_type", F.lit('"::JSON::'))
    fn = F.concat(F.lit("<=V8 FUNCTION=> scriptID="), k, F.lit(" (1,2) run"))
    line = F.concat(F.lit("12:00 Home URL: http://x/"), k, F.lit(" "))
    return I.events(spark, sf).select(
        "event_id", fx.payload(json, "json").alias("json"), fx.payload(fn, "function").alias("fn"),
        fx.last_token(line).alias("token"))


def _written(spark, df: DataFrame, by: str, order: str, text: str) -> str:
    """Text files, one per value of ``by``, in order; the folder that holds them."""
    path = scratch_path(spark)
    df.select(F.col(by).alias("part"), F.col(order).alias("_o"), F.col(text).alias("value")).repartition(
        "part").sortWithinPartitions("part", "_o").drop("_o").write.partitionBy("part").text(path)
    return path


# eight files of the lines of many users each: a user's lines follow each other in one file
@query("session_scan", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place
FROM events""")
def session_scan(spark, sf):
    path = scratch_path(spark)
    I.events(spark, sf).select("user_id", "event_id").repartitionByRange(8, "user_id").sortWithinPartitions(
        "user_id", "event_id").select(F.concat(F.col("user_id").cast("string"), F.lit(" "), F.col("event_id").cast(
            "string")).alias("value")).write.text(path)
    lines = logs.read_sessions(spark, path).withColumns({
        "user": F.split("line", " ")[0], "event_id": F.split("line", " ")[1].cast("long")})
    first = lines.groupBy("log_id", "user").agg(F.min("line_no").alias("first"))
    return lines.join(first, ["log_id", "user"]).select(
        "event_id", (F.col("line_no") - F.col("first")).cast("long").alias("place"))


_DIGESTS = """f AS (SELECT doc_id % 50 AS part, string_agg(md5(text) || chr(10), '' ORDER BY doc_id) AS content
  FROM documents GROUP BY 1)"""


def _digest_files(spark, sf) -> str:
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 50).alias("slot"), F.md5("text").alias("line"))
    return _written(spark, docs, "slot", "doc_id", "line")


@query("file_hashes", f"""WITH {_DIGESTS} SELECT sha256(content) AS file_hash, length(content) AS length FROM f""")
def file_hashes(spark, sf):
    return files.hash_files(spark, _digest_files(spark, sf)).select("file_hash", "length")


@query("quiet_files", f"""WITH {_DIGESTS} SELECT count(*) AS quiet, sum(length(content))::BIGINT AS bytes,
  0::BIGINT AS quiet_now FROM f""")
def quiet_files(spark, sf):
    path = _digest_files(spark, sf)
    later = files.quiet_files(spark, path, now="2100-01-01 00:00:00")
    now = files.quiet_files(spark, path).agg(F.count(F.lit(1)))
    return later.agg(F.count(F.lit(1)).alias("quiet"), F.sum("length").alias("bytes")).withColumn(
        "quiet_now", now.scalar())


# results come as text; what is not a number becomes NULL
@query("job_results_round_trip", f"""WITH {I.EVENTS} SELECT event_type AS ip_type, 'job' || event_id AS job_name,
  CASE WHEN k % 5 <> 0 THEN k / 10 END AS total_time, CASE WHEN k % 3 <> 0 THEN k END AS ads_opened FROM ev""")
def job_results_round_trip(spark, sf):
    path, k = scratch_path(spark), F.col("k")
    results = I.events(spark, sf).select(
        "event_id", F.concat(F.lit("job"), F.col("event_id").cast("string")).alias("job_name"),
        F.col("event_type").alias("ip_type"),
        F.when(k % 5 == 0, "n/a").otherwise((k / 10).cast("string")).alias("total_time"),
        F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("ads_opened"))
    for half in (0, 1):
        files.append_results(results.where(F.col("event_id") % 2 == half).drop("event_id"), path)
    return files.read_job_results(spark, path).select("ip_type", "job_name", "total_time", "ads_opened")


@query("url_helpers", """WITH h AS (SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http:' || substr(url, strpos(url, '//')) WHEN 1 THEN
    'https:' || substr(url, strpos(url, '//')) ELSE substr(url, strpos(url, '//')) END AS completed,
  CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE host END AS no_www, substr(host, 5) AS cut,
  page_id % 4 <> 3 AS ignorable FROM h""")
def url_helpers(spark, sf):
    n = F.col("page_id")
    on = F.when(n % 3 == 0, "http://x/").when(n % 3 == 1, "https://x/").otherwise("ftp://x/")
    bare = F.regexp_replace("url", "^[a-z]+:", "")
    seen = F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(F.lit("chrome-extension://"), "url")).when(
        n % 4 == 2, "about:blank").otherwise(F.col("url"))
    host = urls.netloc("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.complete_scheme(bare, on).alias("completed"), urls.strip_www(host).alias("no_www"),
        urls.strip_www(host, exact=True).alias("cut"), fx.ignorable_url(seen).alias("ignorable"))


@query("sessions_with_ads", """SELECT (doc_id // 10)::VARCHAR AS log_id, count(*) AS ads FROM documents
WHERE doc_id % 3 <> 0 GROUP BY 1""")
def sessions_with_ads(spark, sf):
    p = F.col("line_no")
    ads = I.page_ads(spark, sf).select(
        F.floor(p / 10).cast("string").alias("log_id"),
        F.when(p % 3 == 0, F.slice("redirections", 1, 0)).otherwise(F.col("redirections")).alias("redirections"))
    return chains.sessions_with_ads(ads)


@query("unqueried_domains", f"""WITH {I.VERDICTS}, d AS (SELECT 'd' || c_custkey AS domain FROM customer)
SELECT domain FROM d WHERE domain NOT IN (SELECT domain FROM verdicts)""")
def unqueried_domains(spark, sf):
    known = table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("domain"))
    return reputation.unqueried(reputation.verdict_table(known, I.verdict_log(spark, sf)),
                                "first_query_time").select("domain")


@query("first_frame_inserts", f"""WITH {I.PAGE_EVENTS} SELECT user_id::VARCHAR AS log_id, frame, min(seq) AS seq
FROM pe WHERE w = 'html' GROUP BY 1, 2""")
def first_frame_inserts(spark, sf):
    return records.first_frame_insert(records.route_events(I.page_events(spark, sf)))


# what explains the listeners that edges come from: their own frame's edge, else the earliest of any
@query("listener_lookup", f"""WITH {I.PAGE_EVENTS}, l AS (SELECT * FROM resolved WHERE dk = 'event_listener'),
  loose AS (SELECT user_id, dv, d2, arg_min(df, born) AS df, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT r.user_id::VARCHAR AS log_id, r.df AS dst_frame, r.dv AS dst_value, r.born,
  coalesce(x.df, o.df) AS next_frame FROM resolved r
  LEFT JOIN l x ON x.user_id = r.user_id AND x.df = r.e.f AND x.dv = r.e.v AND x.d2 = r.e.v2
  LEFT JOIN loose o ON o.user_id = r.user_id AND o.dv = r.e.v AND o.d2 = r.e.v2 WHERE r.e.k = 'event_listener'""")
def listener_lookup(spark, sf):
    linked = materialise(chains.lookup_edge(chains.resolve_edges(chains.derive_edges(I.page_events(spark, sf)))))
    led = linked.select(F.col("eid").alias("next"), F.col("dst.frame_id").alias("next_frame"))
    return linked.where("src.kind = 'event_listener'").join(led, "next", "left").select(
        "log_id", F.col("dst.frame_id").alias("dst_frame"), F.col("dst.value").alias("dst_value"), "born", "next_frame")


# a click is answered by a purchase of the same user within an hour; later clicks are still open
@query("unanswered_stream", f"""WITH {I.EVENTS}, w AS (SELECT least(max(ts) FILTER (WHERE event_type = 'click'),
    max(ts) FILTER (WHERE event_type = 'purchase')) AS passed FROM ev)
SELECT event_id FROM ev c, w WHERE event_type = 'click' AND c.ts + INTERVAL 1 HOUR < passed AND NOT EXISTS (
  SELECT 1 FROM ev p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts >= c.ts
    AND p.ts <= c.ts + INTERVAL 1 HOUR)""")
def unanswered_stream(spark, sf):
    def events_of(kind: str, at: str, *cols: str) -> DataFrame:
        return _event_stream(spark, sf).where(F.col("event_type") == kind).select(
            *cols, "user_id", F.col("ts").alias(at))

    open_ = streams.unanswered_stream(events_of("click", "seen_at", "event_id"),
                                      events_of("purchase", "answered_at"), "user_id", "1 hour")
    return streams.run_available(open_).select("event_id")
