"""Inputs of the operators, derived from the given tables, and the same inputs as SQL.

Ads come from documents (the text is read as a 9x9 picture of letter counts and hashed) and from
pages (with redirect chains); browser events, polling attempts, observations and verdicts come
from events; page elements come from lineitem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adtrail.functions import bits
from adtrail.plans.cut import materialise, spread
from adtrail.plans.groups import number_rows, ordered

LETTERS = "etaonisrh"
SIDE = 9

#: Suffix rules of the bindings, and endings that they give to hosts: plain, two-label, wildcard,
#: exception and unlisted ones.
SUFFIX_RULES = ("com", "net", "org", "uk", "co.uk", "pl", "gov.pl", "*.ck", "!www.ck", "jp", "*.kobe.jp",
                "!city.kobe.jp")
SUFFIXES = ("com", "co.uk", "gov.pl", "pl", "shop.ck", "www.ck", "kobe.jp", "city.kobe.jp", "unlisted")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def suffix_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")


def ending(n: Column) -> Column:
    """One of `SUFFIXES` by number."""
    return F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (n % len(SUFFIXES) + 1).cast("int"))


def ending_sql(n: str) -> str:
    return f"[{', '.join(repr(x) for x in SUFFIXES)}][({n}) % {len(SUFFIXES)} + 1]"


def host_sql(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-z]+://([^/?#:]*)', 1))"


def domains_sql(urls: str) -> str:
    """``dom(host, domain)`` of all hosts of the query ``urls(url)``, by `SUFFIX_RULES`."""
    rules = ", ".join(f"('{r.lstrip('*!').lstrip('.')}', {-1000 if r[0] == '!' else int(r[0] == '*')})"
                      for r in SUFFIX_RULES)
    return f"""rk(tail, more) AS (VALUES {rules}),
  hn AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT {host_sql('url')} AS host FROM ({urls}))),
  tl AS (SELECT host, i, array_to_string(l[len(l) - i + 1:], '.') AS tail
    FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM hn)),
  sz AS (SELECT host, coalesce(max(i - 1) FILTER (WHERE more < 0), max(i + more)) AS size
    FROM tl JOIN rk USING (tail) GROUP BY 1),
  dom AS MATERIALIZED (SELECT host, CASE WHEN len(l) > coalesce(size, 1)
    THEN array_to_string(l[len(l) - coalesce(size, 1):], '.') ELSE '' END AS domain
    FROM hn LEFT JOIN sz USING (host))"""


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their URLs moved from the example domains to hosts of their own under `SUFFIXES`."""
    head, rest = (F.regexp_extract("url", x, 1) for x in (r"^(.*?)\.example\.[a-z]+/", r"\.example\.[a-z]+(/.*)$"))
    return table(spark, sf, "pages").select("page_id", F.concat(
        head, F.lit("."), ending(F.col("page_id")), rest).alias("url"))


PAGE_URLS = f"""pu AS MATERIALIZED (SELECT page_id, regexp_extract(url, '^(.*?)[.]example[.][a-z]+/', 1) || '.' ||
    {ending_sql('page_id')} || regexp_extract(url, '[.]example[.][a-z]+(/.*)$', 1) AS url FROM pages)"""


# --- documents as screenshots --------------------------------------------------------------
def letter_grid(text: str) -> Column:
    """81 counts: nine letters in nine consecutive parts of the whole text."""
    n = F.length(text)

    def part(r: Column) -> Column:
        start = F.floor(n * r / SIDE).cast("int")
        return F.substring(F.col(text), start + 1,
                           F.floor(n * (r + 1) / SIDE).cast("int") - start)

    def counts(p: Column) -> Column:
        return F.array(*[F.octet_length(p) - F.octet_length(F.replace(p, F.lit(c), F.lit("")))
                         for c in LETTERS])

    return F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), part), counts))


def document_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its hash, written once as a crawl would store it."""
    docs = spread(table(spark, sf, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars"))
    return materialise(docs.withColumn("grid", letter_grid("text")).select(
        "doc_id", "lang", "source", "n_chars", bits.dhash("grid").alias("screenshot_hash")))


def document_ads(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.when(F.col("n_chars") % 97 == 0, ".png").otherwise(".html")
    return document_hashes(spark, sf).select(
        F.col("doc_id").cast("string").alias("log_id"), F.col("doc_id").alias("line_no"),
        "screenshot_hash", F.concat("source", F.lit("-example.com")).alias("domain"),
        F.concat(F.lit("http://"), "lang", F.lit("."), "source", F.lit("-example.com/"),
                 F.col("doc_id").cast("string"), ext).alias("ad_url"),
        F.substring("source", 4, 10).cast("int").alias("label"), "lang",
        F.concat(F.lit("pub"), (F.col("doc_id") % 37).cast("string"), F.lit(".example.org"))
        .alias("seed_domain"))


def _hash_sql() -> str:
    seg = ", ".join(
        f"substr(text, CAST(floor(n*{r}/9.0) AS BIGINT)+1, "
        f"CAST(floor(n*{r + 1}/9.0)-floor(n*{r}/9.0) AS BIGINT)) AS s{r}" for r in range(SIDE))
    cells = ", ".join(
        f"strlen(s{r})-strlen(replace(s{r},'{ch}','')) AS g{r * SIDE + i}"
        for r in range(SIDE) for i, ch in enumerate(LETTERS))
    order = [(y * SIDE + x, y * SIDE + x + 1) for y in range(8) for x in range(8)]
    order += [(y * SIDE + x, y * SIDE + x + SIDE) for y in range(8) for x in range(8)]
    digits = " || ".join(
        "substr('0123456789abcdef', 1+" + "+".join(
            f"(g{a}<g{b})::INT*{8 >> j}" for j, (a, b) in enumerate(order[i:i + 4])) + ", 1)"
        for i in range(0, 128, 4))
    return (f"dh AS MATERIALIZED (SELECT doc_id, lang, source, n_chars, {digits} AS screenshot_hash "
            f"FROM (SELECT doc_id, lang, source, n_chars, {cells} FROM (SELECT doc_id, lang, "
            f"source, n_chars, {seg} FROM (SELECT *, length(text) AS n FROM documents))))")


DOC_HASHES = _hash_sql()
DOC_ADS = DOC_HASHES + """, ads AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS log_id, doc_id AS line_no, screenshot_hash,
    source || '-example.com' AS domain,
    'http://' || lang || '.' || source || '-example.com/' || doc_id ||
      CASE WHEN n_chars % 97 = 0 THEN '.png' ELSE '.html' END AS ad_url,
    CAST(substr(source, 4) AS INT) AS label, lang,
    'pub' || (doc_id % 37) || '.example.org' AS seed_domain FROM dh)"""


def ham_sql(a: str, b: str) -> str:
    """Differing bits of two hex hashes in SQL."""
    return "(" + " + ".join(
        f"bit_count(xor(('0x'||substr({a},{1 + 8 * i},8))::BIGINT, "
        f"('0x'||substr({b},{1 + 8 * i},8))::BIGINT))" for i in range(4)) + ")"


# --- pages as ads with chains --------------------------------------------------------------
def _hop(p: Column, kind: Column) -> Column:
    s = p.cast("string")
    m = F.md5(s)
    return (
        F.when(kind == 0, F.concat(F.lit("http://a.example.com/adServe/banners?tid="), s))
        .when(kind == 1, F.concat(F.lit("http://w.popcash.net/"), s))
        .when(kind == 2, F.concat(F.lit("http://c"), (p % 7).cast("string"),
                                  F.lit(".example."), ending(p % 7), F.lit("/prod/redirect.html?x="), s))
        .when(kind == 3, F.concat(F.lit("http://serve.popads.net/s?c="), s))
        .when(kind == 4, F.concat(F.lit("http://popmyads.com/"), s))
        .when(kind == 5, F.concat(F.lit("http://h"), (p % 15).cast("string"),
                                  F.lit(".example."), ending(p % 15), F.lit("/"), F.substring(m, 1, 2), F.lit("/"),
                                  F.substring(m, 3, 2), F.lit("/"), F.substring(m, 5, 2),
                                  F.lit("/"), m, F.lit(".js")))
        .when(kind == 6, F.concat(F.lit("http://hilltopads.net/"), s))
        .when(kind == 7, F.concat(F.lit("http://ads.clicksor.net/"), s))
        .when(kind == 8, F.concat(F.lit("http://d"), (p % 9).cast("string"),
                                  F.lit(".cloudfront.net/?abcde="),
                                  F.lpad((p % 1000000).cast("string"), 6, "0")))
        .when(kind == 9, F.concat(F.lit("http://onclkds.com/apu.php?zoneid="), s))
        .when(kind == 10, F.lit("http://moradu.com/apu.php"))
        .when(kind == 11, F.concat(F.lit("http://h.example.com/banners/script/ui_tag_"), s,
                                   F.lit(".js")))
        .otherwise(F.concat(F.lit("http://nothing.example.org/"), s)))


def _hop_sql(kind: str) -> str:
    return f"""CASE {kind}
      WHEN 0 THEN 'http://a.example.com/adServe/banners?tid=' || p
      WHEN 1 THEN 'http://w.popcash.net/' || p
      WHEN 2 THEN 'http://c' || (p % 7) || '.example.' || {ending_sql('p % 7')} || '/prod/redirect.html?x=' || p
      WHEN 3 THEN 'http://serve.popads.net/s?c=' || p
      WHEN 4 THEN 'http://popmyads.com/' || p
      WHEN 5 THEN 'http://h' || (p % 15) || '.example.' || {ending_sql('p % 15')} || '/' || substr(md5(p::VARCHAR),1,2) || '/'
        || substr(md5(p::VARCHAR),3,2) || '/' || substr(md5(p::VARCHAR),5,2) || '/'
        || md5(p::VARCHAR) || '.js'
      WHEN 6 THEN 'http://hilltopads.net/' || p
      WHEN 7 THEN 'http://ads.clicksor.net/' || p
      WHEN 8 THEN 'http://d' || (p % 9) || '.cloudfront.net/?abcde=' || lpad((p % 1000000)::VARCHAR,6,'0')
      WHEN 9 THEN 'http://onclkds.com/apu.php?zoneid=' || p
      WHEN 10 THEN 'http://moradu.com/apu.php'
      WHEN 11 THEN 'http://h.example.com/banners/script/ui_tag_' || p || '.js'
      ELSE 'http://nothing.example.org/' || p END"""


def page_ads(spark: SparkSession, sf: str, hashes: DataFrame | None = None) -> DataFrame:
    """An ad per document: its hash, and a page, dealt out in turn, as the landing page."""
    p = F.col("doc_id")
    hashes = document_hashes(spark, sf) if hashes is None else hashes
    hashes = number_rows(hashes.select("doc_id", "screenshot_hash"), ["doc_id"], "_doc")
    pages = number_rows(page_urls(spark, sf), ["page_id"], "_page")
    ads = hashes.withColumn("_page", F.pmod("_doc", table(spark, sf, "pages").agg(F.count(F.lit(1))).scalar()))
    home = F.concat(F.lit("http://www.pub"), (p % 50).cast("string"), F.lit(".example."), ending(p % 50), F.lit("/"))

    def url_node(u: Column, reason: str) -> Column:
        return F.struct(F.lit("f1").alias("frame_id"), F.lit("URL").alias("kind"),
                        u.alias("value"), F.lit(None).cast("string").alias("value2"),
                        F.lit(reason).alias("reason"))

    chain = F.array(
        url_node(F.col("url"), "JS Navigation"),
        url_node(_hop(p, p % 13), "Server Redirect"),
        F.struct(F.lit("f1").alias("frame_id"), F.lit("event_listener").alias("kind"),
                 F.lit("t:1").alias("value"), F.lit("click").alias("value2"),
                 F.lit("click_listener").alias("reason")),
        url_node(_hop(p, F.floor(p / 13) % 13), "Dynamic Script Load"),
        url_node(home, "FIRST"))
    return ads.join(pages, "_page").select(
        p.cast("string").alias("log_id"), p.alias("line_no"), F.col("url").alias("ad_url"),
        home.alias("home_url"), "screenshot_hash", chain.alias("redirections"))


PAGE_ADS = DOC_HASHES + f""", {PAGE_URLS}, pa AS MATERIALIZED (
  SELECT p, url AS ad_url, screenshot_hash,
    'http://www.pub' || (p % 50) || '.example.' || {ending_sql('p % 50')} || '/' AS home_url,
    {_hop_sql('p % 13')} AS hop1, {_hop_sql('(p // 13) % 13')} AS hop2
  FROM (SELECT doc_id AS p, screenshot_hash, (row_number() OVER (ORDER BY doc_id) - 1)
      % (SELECT count(*) FROM pages) AS pn FROM dh)
    JOIN (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS pn FROM pu) USING (pn))"""


def toxic_hashes(spark: SparkSession, sf: str, hashes: DataFrame | None = None) -> DataFrame:
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    hashes = document_hashes(spark, sf) if hashes is None else hashes
    return hashes.join(bad, "doc_id", "left_semi").select(
        "screenshot_hash").distinct()


TOXIC = """bad AS (SELECT DISTINCT screenshot_hash FROM dh
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


# --- events --------------------------------------------------------------------------------
def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumns({
        "k": F.get_json_object("props", "$.k").cast("int"),
        "ts": F.col("ts").cast("timestamp")})


EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def shown(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def shown_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "ts", F.concat(F.lit("http://d"), F.col("user_id").cast("string"), F.lit(".example."),
                       ending(F.col("user_id")), F.lit("/"), "event_type", F.lit("?k="),
                       F.col("k").cast("string")).alias("url"),
        F.col("event_type").alias("campaign"),
        F.when(F.col("k") % 3 == 0, "binary").otherwise("malvert").alias("class"))


OBSERVATIONS = EVENTS + f""", obs AS (SELECT ts,
    'http://d' || user_id || '.example.' || {ending_sql('user_id')} || '/' || event_type || '?k=' || k AS url,
    'd' || user_id || '.example.' || {ending_sql('user_id')} AS domain, '/' || event_type AS url_path,
    event_type AS campaign,
    CASE WHEN k % 3 = 0 THEN 'binary' ELSE 'malvert' END AS class FROM ev)"""


def verdict_text() -> Column:
    error = F.col("event_type") == "error"
    return F.when(error & (F.col("k") % 2 == 0), "[SOCIAL_ENGINEERING/ANY]").when(
        error & (F.col("k") % 5 == 0), "[MALWARE/ANY]").otherwise("None")


def verdict_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"),
        F.col("ts").alias("query_time"), verdict_text().alias("result"))


VERDICTS = EVENTS + """, vl AS (SELECT 'd' || user_id AS domain, ts AS query_time,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN '[SOCIAL_ENGINEERING/ANY]'
         WHEN event_type = 'error' AND k % 5 = 0 THEN '[MALWARE/ANY]' ELSE 'None' END AS result
  FROM ev), vf AS (SELECT *, result <> 'None' AS flag,
    result <> 'None' AND contains(result, 'SOCIAL_ENGINEERING') AS se_flag,
    CASE WHEN result <> 'None' THEN result ELSE '' END AS txt FROM vl),
  hit AS (SELECT domain, min(query_time) AS hit_at FROM vf WHERE flag GROUP BY 1),
  asked AS (SELECT vf.*, hit_at FROM vf LEFT JOIN hit USING (domain)
            WHERE hit_at IS NULL OR query_time <= hit_at),
  verdicts AS MATERIALIZED (SELECT domain, min(query_time) AS first_query_time,
    arg_min(flag, query_time) AS first_flag, arg_min(se_flag, query_time) AS first_se_flag,
    arg_min(txt, query_time) AS first_result, max(query_time) AS last_query_time,
    arg_max(flag, query_time) AS last_flag, arg_max(se_flag, query_time) AS last_se_flag,
    arg_max(txt, query_time) AS last_result FROM asked GROUP BY 1)"""


_AGENTS = {"signup": "edge_win", "click": "chrome_mac", "view": "ie_win"}


def attempts(spark: SparkSession, sf: str, hashes: DataFrame | None = None) -> DataFrame:
    """Polling attempts: fifty events in a row poll one URL, each with the agent of its type. A
    quarter of the URLs leads to another document each time, so that all documents are reached; a
    quarter to one of two, and the rest to one."""
    e = events(spark, sf)
    n, user = F.col("event_id"), F.col("user_id")
    j = F.floor(n / 50)
    agent = F.coalesce(*[F.when(F.col("event_type") == t, a) for t, a in _AGENTS.items()],
                       F.lit("chrome_android"))
    url = F.concat(F.lit("http://m"), j.cast("string"), F.lit("-feed."), ending(j), F.lit("/go?x="),
                   j.cast("string"))
    loaded = F.concat(F.lit("http://www.land"), (j % 23).cast("string"), F.lit("-example."),
                      ending(F.floor(j / 2)), F.lit("/"),
                      F.when(j % 3 == 0, (user % 40).cast("string")).otherwise("a"))
    doc = F.when(j % 4 == 0, 50 * F.floor(j / 4) + n % 50).when(
        j % 4 == 1, j * 31 + 100 * (user % 2)).otherwise(j * 31)
    hashes = document_hashes(spark, sf) if hashes is None else hashes
    numbered = number_rows(hashes.select("doc_id", "screenshot_hash"), ["doc_id"], "_doc").drop("doc_id")
    blank = (F.col("event_type") == "error") & (user % 10 == 0)
    return materialise(e.select(
        "event_id", agent.alias("agent"), url.alias("url"), loaded.alias("loaded_url"),
        F.pmod(doc, hashes.agg(F.count(F.lit(1))).scalar()).alias("_doc"), blank.alias("_blank"),
        F.col("value").alias("total_time"),
        F.when(F.col("event_type") == "purchase", "True").otherwise("False")
        .alias("downloaded_files"),
        F.concat(agent, F.lit(":"), F.url_encode(url)).alias("job_name"),
    ).join(numbered, "_doc").withColumn(
        "image_hash", F.when(F.col("_blank"), "0" * 32).otherwise(F.col("screenshot_hash"))
    ).drop("_doc", "_blank", "screenshot_hash"))


ATTEMPTS = DOC_HASHES + ", " + EVENTS + f""", at0 AS (SELECT event_id, j,
    CASE event_type WHEN 'signup' THEN 'edge_win' WHEN 'click' THEN 'chrome_mac'
      WHEN 'view' THEN 'ie_win' ELSE 'chrome_android' END AS agent,
    'http://m' || j || '-feed.' || {ending_sql('j')} || '/go?x=' || j AS url,
    'http://www.land' || (j % 23) || '-example.' || {ending_sql('j // 2')} || '/' ||
      CASE WHEN j % 3 = 0 THEN (user_id % 40)::VARCHAR ELSE 'a' END AS loaded_url,
    (CASE WHEN j % 4 = 0 THEN 50 * (j // 4) + event_id % 50
      WHEN j % 4 = 1 THEN j * 31 + 100 * (user_id % 2) ELSE j * 31 END) % (SELECT count(*) FROM dh) AS doc,
    event_type = 'error' AND user_id % 10 = 0 AS blank, value AS total_time,
    CASE WHEN event_type = 'purchase' THEN 'True' ELSE 'False' END AS downloaded_files
  FROM (SELECT *, event_id // 50 AS j FROM ev)),
  {domains_sql('SELECT loaded_url AS url FROM at0 UNION SELECT url FROM at0')},
  att AS MATERIALIZED (SELECT at0.*, l.domain AS landed, u.domain AS polled,
    CASE WHEN blank THEN repeat('0', 32) ELSE screenshot_hash END AS image_hash
  FROM at0 JOIN (SELECT screenshot_hash, row_number() OVER (ORDER BY doc_id) - 1 AS doc FROM dh) USING (doc)
    JOIN dom l ON l.host = {host_sql('loaded_url')} JOIN dom u ON u.host = {host_sql('url')})"""


def sources(spark: SparkSession, sf: str, hashes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Known domains, hashes and upstream domains for the funnel."""
    nations = table(spark, sf, "nation")
    n = F.col("n_nationkey")
    docs = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    hashes = document_hashes(spark, sf) if hashes is None else hashes
    return {
        "ad_domains": nations.select(F.concat(
            F.lit("land"), (n % 23).cast("string"), F.lit("-example."), ending(F.floor(n / 2)))
            .alias("ad_domain")),
        "image_hashes": hashes.join(docs, "doc_id", "left_semi").select(
            F.col("screenshot_hash").alias("image_hash")).distinct(),
        "upstream_domains": nations.select(F.concat(
            F.lit("m"), (n * 9).cast("string"), F.lit("-feed."), ending(n * 9))
            .alias("upstream_domain")),
    }


SOURCES = ATTEMPTS + f""", ad_domains AS (SELECT 'land' || (n_nationkey % 23) || '-example.' ||
    {ending_sql('n_nationkey // 2')} AS d FROM nation),
  known AS MATERIALIZED (SELECT DISTINCT screenshot_hash AS h FROM dh
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
  ups AS (SELECT 'm' || (n_nationkey * 9) || '-feed.' || {ending_sql('n_nationkey * 9')} AS d FROM nation)"""


# --- browser events ------------------------------------------------------------------------
def browser_events(spark: SparkSession, sf: str) -> DataFrame:
    """One log per user: signup starts a script, purchase ends it, click navigates or sets a
    link, view loads a frame, error is a server redirect."""
    e, k = events(spark, sf), F.col("k")
    kind = F.col("event_type")

    def at(prefix: str, n: int) -> Column:
        return F.concat(F.lit(f"http://{prefix}"), (k % n).cast("string"), F.lit(".example.com/"))

    frame = F.concat(F.lit("f"), (k % 3).cast("string"))
    header = F.concat(F.lit("LOG::Page::"), F.when(kind == "signup", "DidCompileScript").when(
        kind == "purchase", "DidRunCompiledScriptEnd").when(
        (kind == "click") & (k % 2 == 0), "WillNavigateFrame").when(
        kind == "click", "DidCallV8SetAttribute").when(
        kind == "view", "WillLoadFrame").otherwise("DidReceiveMainResourceRedirect"),
        F.lit(" :"))
    pairs = {
        "frame": frame, "main_frame": F.lit("f0"), "origin_frame": frame,
        "frame_url": at("p", 11), "local_frame_root": F.lit("f0"),
        "local_frame_root_url": F.lit("http://top.example.com/"),
        "url": F.when(kind == "signup", at("s", 10)).otherwise(at("n", 20)),
        "load_url": at("n", 20), "scriptID": k.cast("string"),
        "request_url": at("n", 20), "redirect_url": at("r", 6),
        "interface": F.lit("HTMLAnchorElement"), "attribute": F.lit("href"),
        "value": F.concat(F.lit('::JSON::"'), at("n", 20), F.lit('"::JSON::')),
    }
    fields = F.create_map(*[x for n, c in pairs.items() for x in (F.lit(n), c)])
    empty = F.create_map().cast("map<string,string>")
    return materialise(e.select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").alias("seq"),
        header.alias("header"), fields.alias("fields"), empty.alias("args"),
        empty.alias("attrs")))


# spans of scripts per (user, frame) by running sums, as an oracle for the stack
BROWSER = EVENTS + """, be AS (SELECT user_id, event_id AS seq, event_type AS t, k,
    'f' || (k % 3) AS frame, 'http://p' || (k % 11) || '.example.com/' AS frame_url,
    'http://n' || (k % 20) || '.example.com/' AS n_url,
    'http://s' || (k % 10) || '.example.com/' AS s_url,
    'http://r' || (k % 6) || '.example.com/' AS r_url FROM ev),
  marks AS (SELECT user_id, seq, frame AS root, frame, s_url,
    CASE t WHEN 'signup' THEN 1 ELSE -1 END AS d, NULL::INT AS pos, 1 AS tie
    FROM be WHERE t IN ('signup', 'purchase')),
  asks AS (SELECT user_id, seq, frame AS root, frame, NULL AS s_url, 0 AS d, 0 AS pos, 0 AS tie
    FROM be WHERE t = 'click'
    UNION ALL SELECT user_id, seq, 'f0', frame, NULL, 0, 1, 0 FROM be WHERE t = 'click'),
  summed AS (SELECT *, sum(d) OVER w AS s FROM (SELECT * FROM marks UNION ALL SELECT * FROM asks)
    WINDOW w AS (PARTITION BY user_id, root ORDER BY seq, tie, pos)),
  floored AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY user_id, root
    ORDER BY seq, tie, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lowest
    FROM summed),
  levels AS (SELECT *, s - least(lowest, s) + CASE WHEN d < 0 AND s >= lowest THEN 1 ELSE 0 END
    AS level FROM floored),
  opened AS MATERIALIZED (SELECT *, last_value(CASE WHEN d > 0 THEN frame END IGNORE NULLS)
    OVER w AS run_frame, last_value(CASE WHEN d > 0 THEN s_url END IGNORE NULLS) OVER w AS run_url
    FROM levels WINDOW w AS (PARTITION BY user_id, root, level ORDER BY seq, tie, pos)),
  runner AS MATERIALIZED (SELECT user_id, seq, arg_min(run_frame, pos) AS run_frame,
    arg_min(run_url, pos) AS run_url FROM opened WHERE d = 0 AND run_frame IS NOT NULL
    GROUP BY 1, 2)"""


def page_events(spark: SparkSession, sf: str) -> DataFrame:
    """One log per user with records of every kind: scripts in three frames, handlers in a frame of
    their own, child frames, popups and announced frames."""
    e, k, t = events(spark, sf), F.col("k"), F.col("event_type")

    def name(prefix: str, n: int) -> Column:
        return F.concat(F.lit(prefix), (k % n).cast("string"))

    def at(prefix: str, n: int) -> Column:
        return F.concat(F.lit("http://"), name(prefix, n), F.lit(".example.com/"))

    def json(c: Column) -> Column:
        return F.concat(F.lit('::JSON::"'), c, F.lit('"::JSON::'))

    def one_of(*kinds: str) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % len(kinds) + 1).cast("int"))

    what = F.when(t == "signup", "begin").when(t == "purchase", F.when(k < 55, "end").when(k < 62, "child").when(
        k < 74, "html").when(k < 88, "target").when(k < 96, "lazy").otherwise("call")).when(
        t == "click", one_of("nav", "href", "src", "listen", "onset", "raf", "timer", "insert", "method")).when(
        t == "view", F.when((k >= 60) & (k < 80), "open").otherwise("load")).otherwise(
        one_of("meta", "push1", "push2", "redirect"))
    e = e.withColumn("what", what)
    w = F.col("what")
    handler = w.isin("target", "lazy", "call") | ((w == "nav") & (k >= 45))
    announced = (w == "html") | ((w == "load") & (k >= 85))
    frame = F.when(handler, "h0").when(announced, name("u", 3)).when(w == "child", "f0").when(
        (w == "load") & (k >= 80), name("w", 4)).when((t == "click") & (k >= 60), name("c", 2)).otherwise(name("f", 3))
    n_url = F.when(((w == "nav") & (k >= 45)) | ((w == "load") & (k >= 85)), at("n", 2)).otherwise(at("n", 20))
    headers = {
        "begin": "DidCompileScript", "end": "DidRunCompiledScriptEnd", "child": "DidCreateChildFrame",
        "html": "DidInsertDOMNode", "target": "DidCallHandleEventBegin", "lazy": "DidCompileLazyEventListener",
        "call": "DidCallFunctionBegin", "nav": "WillNavigateFrame", "href": "DidCallV8SetAttribute",
        "src": "DidCallV8SetAttribute", "listen": "DidCallV8MethodTemplate",
        "onset": "DidCallV8SetAttributeEventListener", "raf": "RequestAnimationFrame",
        "timer": "DidCallV8MethodTemplate", "insert": "DidInsertDOMNode", "method": "DidCallV8MethodTemplate",
        "open": "WindowOpen", "load": "WillLoadFrame", "meta": "DidHandleHttpRefresh",
        "push1": "DidCallV8MethodCallback", "push2": "DidCallV8MethodTemplate",
        "redirect": "DidReceiveMainResourceRedirect"}

    def by_kind(values: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(w == x, v) for x, v in values.items()])

    fields = {
        "frame": frame, "main_frame": F.lit("f0"), "origin_frame": frame, "frame_url": at("p", 11),
        "local_frame_root": F.lit("f0"), "local_frame_root_url": F.lit("http://top.example.com/"),
        "url": F.when(w == "begin", at("s", 10)).otherwise(n_url), "load_url": n_url, "request_url": n_url,
        "redirect_url": at("r", 6), "refresh_url": n_url, "scriptID": F.lit("7"), "callback_debug_name": F.lit("go"),
        "current_target": name("t", 2), "cpp_impl_ptr": name("t", 2), "event": F.lit("click"),
        "child_frame": name("c", 2), "callback_id": (k % 6).cast("string"),
        "node": F.when(w == "html", "HTML").otherwise("SCRIPT"),
        "src_url": F.concat(F.lit("//"), name("cdn", 5), F.lit(".example.com/x.js")), "value": json(n_url),
        "interface": by_kind({"href": "HTMLAnchorElement", "src": "HTMLScriptElement", "listen": "EventTarget",
                              "timer": "Window", "method": "Element", "push1": "History", "push2": "History"}),
        "attribute": by_kind({"href": "href", "src": "src", "listen": "addEventListener", "timer": "setTimeout",
                              "method": "setAttribute", "push1": "pushState", "push2": "pushState",
                              "onset": "onclick"})}
    args = {"type": json(F.lit("click")), "listener": F.lit("<=V8 FUNCTION=> scriptID=7 go"),
            "handler": json(name("go", 4)), "name": json(F.lit("href")), "value": json(n_url)}
    maps = [F.create_map(*[x for n, c in m.items() for x in (F.lit(n), c)]) for m in (fields, args)]
    return materialise(e.select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit("LOG::Page::"), by_kind(headers), F.lit(" :")).alias("header"),
        maps[0].alias("fields"), maps[1].alias("args"),
        F.create_map().cast("map<string,string>").alias("attrs")))


# the same records, then frame families by recursion, spans by running sums, and all edges (``raw``)
PAGE_EVENTS = EVENTS + """, pe0 AS (SELECT user_id, event_id AS seq, event_type AS t, k, CASE event_type
    WHEN 'signup' THEN 'begin'
    WHEN 'purchase' THEN CASE WHEN k < 55 THEN 'end' WHEN k < 62 THEN 'child' WHEN k < 74 THEN 'html'
      WHEN k < 88 THEN 'target' WHEN k < 96 THEN 'lazy' ELSE 'call' END
    WHEN 'click' THEN ['nav','href','src','listen','onset','raf','timer','insert','method'][k % 9 + 1]
    WHEN 'view' THEN CASE WHEN k >= 60 AND k < 80 THEN 'open' ELSE 'load' END
    ELSE ['meta','push1','push2','redirect'][k % 4 + 1] END AS w FROM ev),
  pe AS MATERIALIZED (SELECT *, CASE WHEN w IN ('target','lazy','call') OR (w = 'nav' AND k >= 45) THEN 'h0'
      WHEN w = 'html' OR (w = 'load' AND k >= 85) THEN 'u' || (k % 3) WHEN w = 'child' THEN 'f0'
      WHEN w = 'load' AND k >= 80 THEN 'w' || (k % 4) WHEN t = 'click' AND k >= 60 THEN 'c' || (k % 2)
      ELSE 'f' || (k % 3) END AS frame,
    'http://n' || (k % CASE WHEN (w = 'nav' AND k >= 45) OR (w = 'load' AND k >= 85) THEN 2 ELSE 20 END)
      || '.example.com/' AS n_url,
    'http://p' || (k % 11) || '.example.com/' AS p_url, 'http://s' || (k % 10) || '.example.com/' AS s_url,
    'http://r' || (k % 6) || '.example.com/' AS r_url, 't' || (k % 2) AS target FROM pe0),
  opening AS (SELECT *, last_value(CASE WHEN w = 'open' THEN frame END IGNORE NULLS) OVER o AS opener,
      last_value(CASE WHEN w = 'open' THEN seq END IGNORE NULLS) OVER o AS opened_at
    FROM pe WHERE w IN ('open', 'load') WINDOW o AS (PARTITION BY user_id ORDER BY seq)),
  loads AS MATERIALIZED (SELECT * FROM opening WHERE w = 'load' AND opener IS NOT NULL),
  links AS (SELECT user_id, 'c' || (k % 2) AS frame, 'f0' AS parent, seq FROM pe WHERE w = 'child'
    UNION ALL SELECT user_id, arg_min(frame, seq), arg_min(opener, seq), min(seq) FROM loads GROUP BY user_id, opened_at),
  parents AS MATERIALIZED (SELECT user_id, frame, arg_max(parent, seq) AS parent FROM links WHERE frame <> parent
    GROUP BY 1, 2),
  climb AS (WITH RECURSIVE c(user_id, frame, cur, path) AS (
    SELECT user_id, frame, parent, [frame] FROM parents
    UNION ALL SELECT c.user_id, c.frame, p.parent, list_append(c.path, c.cur) FROM c
      JOIN parents p ON p.user_id = c.user_id AND p.frame = c.cur WHERE NOT list_contains(c.path, c.cur))
    SELECT * FROM c),
  families AS MATERIALIZED (SELECT user_id, frame, CASE WHEN list_contains(path, cur)
      THEN list_min(path[list_position(path, cur):]) ELSE cur END AS root FROM climb
    QUALIFY row_number() OVER (PARTITION BY user_id, frame ORDER BY len(path) DESC) = 1),
  handled AS (SELECT *, lag(w) OVER h AS last_w, lag(target) OVER h AS last_target
    FROM pe WHERE w IN ('target', 'lazy', 'call') WINDOW h AS (PARTITION BY user_id, frame ORDER BY seq)),
  ran AS (SELECT user_id, seq, frame, w, p_url, last_target || ':7 go' AS name FROM handled
    WHERE w <> 'target' AND last_w = 'target'),
  marked AS (
    SELECT user_id, seq, frame, CASE w WHEN 'begin' THEN 1 ELSE -1 END AS d, NULL::INT AS pos, 1 AS tie,
      'URL' AS kind, s_url AS value, NULL::VARCHAR AS value2 FROM pe WHERE w IN ('begin', 'end')
    UNION ALL SELECT user_id, seq, frame, 1, NULL, 1, 'event_listener', name, 'click' FROM ran
    UNION ALL SELECT user_id, seq, unnest(CASE WHEN w IN ('raf', 'insert') THEN [frame] ELSE [frame, 'f0'] END), 0,
      unnest(CASE WHEN w IN ('raf', 'insert') THEN [0] ELSE [0, 1] END), 0, NULL, NULL, NULL
      FROM pe WHERE t = 'click'
    UNION ALL SELECT user_id, seq, opener, 0, 0, 0, NULL, NULL, NULL FROM loads),
  summed AS (SELECT m.*, coalesce(root, frame) AS root, sum(d) OVER o AS s FROM marked m
    LEFT JOIN families USING (user_id, frame)
    WINDOW o AS (PARTITION BY user_id, coalesce(root, frame) ORDER BY seq, tie, pos)),
  floored AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY user_id, root
    ORDER BY seq, tie, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lowest FROM summed),
  levels AS (SELECT *, s - least(lowest, s) + CASE WHEN d < 0 AND s >= lowest THEN 1 ELSE 0 END AS level FROM floored),
  opened AS MATERIALIZED (SELECT *, last_value(CASE WHEN d > 0
      THEN {'f': frame, 'k': kind, 'v': value, 'v2': value2} END IGNORE NULLS)
    OVER (PARTITION BY user_id, root, level ORDER BY seq, tie, pos) AS r FROM levels),
  runner AS MATERIALIZED (SELECT user_id, seq, arg_min(r, pos) AS r FROM opened WHERE d = 0 AND r IS NOT NULL
    GROUP BY 1, 2),
  hist AS (SELECT *, lag(w) OVER h AS last_w, lag(p_url) OVER h AS last_url
    FROM pe WHERE w IN ('push1', 'push2') WINDOW h AS (PARTITION BY user_id, frame ORDER BY seq)),
  base AS MATERIALIZED (
    SELECT user_id, seq, frame AS df, 'URL' AS dk, n_url AS dv, NULL::VARCHAR AS d2, frame AS sf, 'URL' AS sk,
      r_url AS sv, NULL::VARCHAR AS s2, 'Server Redirect' AS reason, 1 AS policy FROM pe WHERE w = 'redirect'
    UNION ALL SELECT user_id, seq, frame, 'URL', n_url, NULL, frame, 'URL', p_url, NULL, 'Meta Refresh', 1
      FROM pe WHERE w = 'meta'
    UNION ALL SELECT user_id, seq, frame, 'URL', p_url, NULL, frame, 'URL', last_url, NULL, 'History Push State', 1
      FROM hist WHERE w = 'push2' AND last_w = 'push1' AND p_url <> last_url
    UNION ALL SELECT pe.user_id, pe.seq, pe.frame, 'URL', s_url, NULL, pe.frame, 'URL', p_url, NULL, 'Script Load', 1
      FROM pe JOIN opened o USING (user_id, seq) WHERE w = 'begin' AND o.level = 1
    UNION ALL SELECT user_id, seq, frame, 'event_listener', name, 'click', frame, 'URL', p_url, NULL,
      'dom0_click_listener', 0 FROM ran WHERE w = 'lazy'
    UNION ALL SELECT user_id, seq, frame,
      CASE w WHEN 'listen' THEN 'event_listener' WHEN 'onset' THEN 'event_listener'
        WHEN 'raf' THEN 'request_animation_frame' WHEN 'timer' THEN 'scheduled_action' ELSE 'URL' END,
      CASE w WHEN 'listen' THEN target || ':7 go' WHEN 'onset' THEN target || ':7 go'
        WHEN 'raf' THEN (k % 6)::VARCHAR WHEN 'timer' THEN 'code'
        WHEN 'insert' THEN 'http://cdn' || (k % 5) || '.example.com/x.js' ELSE n_url END,
      CASE w WHEN 'listen' THEN 'click' WHEN 'onset' THEN 'click' WHEN 'timer' THEN 'go' || (k % 4) END,
      r.f, r.k, r.v, r.v2, CASE w WHEN 'nav' THEN 'JS Navigation' WHEN 'href' THEN 'Anchor link setup - set att'
        WHEN 'src' THEN 'Dynamic Script Load - set att' WHEN 'listen' THEN 'click_listener'
        WHEN 'onset' THEN 'on_click_listener' WHEN 'raf' THEN 'animation_callback' WHEN 'timer' THEN 'scheduled_action'
        WHEN 'insert' THEN 'Dynamic Script Load' ELSE 'Anchor link setup - set att method' END,
      CASE w WHEN 'listen' THEN 0 ELSE 1 END FROM pe JOIN runner USING (user_id, seq) WHERE t = 'click'),
  -- every load makes an edge into its node, whatever explains it
  into_url AS (SELECT user_id, df AS opener, dv AS n_url, min(seq) AS linked_at FROM (
    SELECT user_id, df, dv, seq FROM base WHERE dk = 'URL'
    UNION ALL SELECT user_id, frame, n_url, seq FROM pe WHERE w = 'load') GROUP BY ALL),
  judged AS (SELECT l.*, r.r, coalesce(i.linked_at < l.seq AND l.opener <> l.frame, false) AS clicked FROM loads l
    LEFT JOIN into_url i USING (user_id, opener, n_url) LEFT JOIN runner r USING (user_id, seq)),
  used AS MATERIALIZED (SELECT * FROM judged WHERE clicked OR r IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id, opened_at ORDER BY seq) = 1),
  rest AS MATERIALIZED (SELECT * FROM pe WHERE w = 'load' AND (user_id, seq) NOT IN (SELECT (user_id, seq) FROM used)),
  sure AS MATERIALIZED (SELECT * FROM base
    UNION ALL SELECT user_id, seq, frame, 'URL', n_url, NULL, CASE WHEN clicked THEN opener ELSE r.f END,
      CASE WHEN clicked THEN 'URL' ELSE r.k END, CASE WHEN clicked THEN n_url ELSE r.v END,
      CASE WHEN clicked THEN NULL ELSE r.v2 END, CASE WHEN clicked THEN 'Anchor link click' ELSE 'Window Open' END, 0
      FROM used
    UNION ALL SELECT user_id, seq, frame, 'URL', n_url, NULL, frame, 'URL', p_url, NULL, 'Frame Load', 1 FROM rest),
  announced AS (SELECT user_id, frame, min(seq) AS at FROM pe WHERE w = 'html' GROUP BY 1, 2),
  asked AS (SELECT l.user_id, l.frame, l.seq, l.n_url FROM (SELECT p.*, row_number() OVER (
      PARTITION BY p.user_id, p.frame ORDER BY p.seq) AS rn FROM pe p JOIN announced a
      ON a.user_id = p.user_id AND a.frame = p.frame AND p.seq > a.at WHERE w = 'load') l
    JOIN rest USING (user_id, seq) WHERE rn = 1)"""
# an announced frame is asked about once, so guesses build on each other at most three times
for _n, _so_far in ((1, "sure"), (2, "(SELECT * FROM sure UNION ALL SELECT * FROM guess1)"),
                    (3, "(SELECT * FROM sure UNION ALL SELECT * FROM guess2)")):
    PAGE_EVENTS += f""", states{_n} AS (SELECT a.user_id, a.seq, a.frame, a.n_url, s.df, min(s.seq) AS born,
      coalesce(arg_max({{'f': sf, 'k': sk, 'v': sv, 'v2': s2, 'why': reason}}, s.seq) FILTER (WHERE policy = 0),
        arg_min({{'f': sf, 'k': sk, 'v': sv, 'v2': s2, 'why': reason}}, s.seq) FILTER (WHERE policy = 1)) AS e
    FROM asked a JOIN {_so_far} s ON s.user_id = a.user_id AND s.dk = 'URL' AND s.dv = a.n_url AND s.seq < a.seq
    GROUP BY a.user_id, a.seq, a.frame, a.n_url, s.df),
  guess{_n} AS MATERIALIZED (SELECT user_id, seq, frame AS df, 'URL' AS dk, n_url AS dv, NULL::VARCHAR AS d2,
      e.f AS sf, e.k AS sk, e.v AS sv, e.v2 AS s2, e.why || ' unknown' AS reason, 0 AS policy
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, seq ORDER BY born, df) AS rn FROM states{_n}
      WHERE e.k <> 'URL') WHERE rn = 1)"""
PAGE_EVENTS += """, raw AS MATERIALIZED (SELECT * FROM sure UNION ALL SELECT * FROM guess3
    UNION ALL SELECT user_id, seq, frame, 'URL', n_url, NULL, frame, 'URL', p_url, NULL, 'Load Frame', 2 FROM rest),
  resolved AS MATERIALIZED (SELECT user_id, df, dk, dv, d2, min(seq) AS born, coalesce(
      arg_max({'f': sf, 'k': sk, 'v': sv, 'v2': s2, 'why': reason}, seq) FILTER (WHERE policy = 0),
      arg_min({'f': sf, 'k': sk, 'v': sv, 'v2': s2, 'why': reason}, seq) FILTER (WHERE policy = 1),
      arg_max({'f': sf, 'k': sk, 'v': sv, 'v2': s2, 'why': reason}, seq) FILTER (WHERE policy = 2)) AS e
    FROM raw GROUP BY user_id, df, dk, dv, d2)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """URL edges between consecutive events of a user: ``(log_id, dst_url, src_url, reason,
    seq)``."""
    e = events(spark, sf).select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit("http://"), "event_type", F.lit(".example.com/"),
                 (F.col("k") % 40).cast("string")).alias("dst_url"),
        F.col("event_type").alias("reason"))
    g = ordered(e, ["log_id"], ["seq"]).previous_row(F.col("dst_url"), "_p")
    return g.result().where("_p is not null").select(
        "log_id", "dst_url", F.col("_p.v").alias("src_url"), "reason", "seq")


STEPS = EVENTS + """, hops AS (SELECT user_id::VARCHAR AS log_id, event_id AS seq,
    'http://' || event_type || '.example.com/' || (k % 40) AS dst_url, event_type AS reason,
    lag('http://' || event_type || '.example.com/' || (k % 40)) OVER (
      PARTITION BY user_id ORDER BY event_id) AS src_url FROM ev),
  steps AS (SELECT * FROM hops WHERE src_url IS NOT NULL AND src_url <> dst_url),
  edges AS MATERIALIZED (SELECT log_id, dst_url, arg_min(src_url, seq) AS src_url,
    arg_min(reason, seq) AS reason, min(seq) AS seq FROM steps GROUP BY 1, 2)"""


# --- page elements -------------------------------------------------------------------------
def elements(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("page_id"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("elem_id"),
        (F.col("l_suppkey") * 13 % 1785 + 1).cast("double").alias("mid_x"),
        (F.col("l_partkey") * 7 % 60 * 16 + 1).cast("double").alias("mid_y"),
        F.col("l_quantity").alias("h"), (F.col("l_discount") * 100 + 1).cast("int").cast("double")
        .alias("w"), (F.col("l_returnflag") == "R").alias("preferred"),
        F.col("l_extendedprice").alias("_tie")
    ).groupBy("page_id", "elem_id").agg(
        F.min_by(F.struct("mid_x", "mid_y", "h", "w", "preferred"), F.struct("_tie", "mid_x", "h"))
        .alias("e")).select("page_id", "elem_id", "e.*")


ELEMENTS = """el AS MATERIALIZED (SELECT page_id, elem_id, mid_x, mid_y, h, w, preferred FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, elem_id ORDER BY tie, mid_x, h) AS rn FROM (
  SELECT l_orderkey AS page_id, l_partkey * 8 + l_linenumber AS elem_id,
    (l_suppkey * 13 % 1785 + 1)::DOUBLE AS mid_x, (l_partkey * 7 % 60 * 16 + 1)::DOUBLE AS mid_y,
    l_quantity AS h, CAST(trunc(l_discount * 100 + 1) AS INT)::DOUBLE AS w,
    l_returnflag = 'R' AS preferred, l_extendedprice AS tie FROM lineitem)) WHERE rn = 1)"""
