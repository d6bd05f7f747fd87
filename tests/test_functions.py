"""Column functions on literal values."""

from pyspark.sql import functions as F

from adtrail import fixed
from adtrail.functions import bits, fields as fx, urls
from adtrail.operators.attribution import identify_network, is_hex_triplet_path, network_of


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_url_parts(spark):
    got = values(
        spark,
        [("http://u:p@WWW.Example.co.uk:80/a/b.js;p=1?x=1#f",), ("//x.org/y",), ("",),
         ("http://10.0.0.1/x.png",), ("http://com/",), ("http://x.com?q=/a",)],
        "u string", urls.netloc("u"), urls.url_path("u"), urls.url_query("u"), urls.fqdn("u"),
        urls.is_image_url("u"))
    assert got == [
        ("u:p@WWW.Example.co.uk:80", "/a/b.js", "x=1", "www.example.co.uk", False),
        ("x.org", "/y", "", "x.org", False),
        ("", "", "", "", False),
        ("10.0.0.1", "/x.png", "", "10.0.0.1", True),
        ("com", "/", "", "com", False),
        ("x.com", "", "q=/a", "x.com", False)]


def test_job_names_and_small_url_helpers(spark):
    row = one(spark, urls.make_job(F.lit("ie_win"), F.lit("http://a.example.com/x y")).alias("j"))
    assert row.j == "ie_win:http%3A%2F%2Fa.example.com%2Fx+y"
    back = one(spark, urls.split_job(F.lit(row.j)).alias("s")).s
    assert (back.agent, back.url) == ("ie_win", "http://a.example.com/x y")
    row = one(spark, urls.complete_scheme(F.lit("//a.js"), F.lit("https://x/")).alias("a"),
              urls.complete_scheme(F.lit("/a.js"), F.lit("https://x/")).alias("b"),
              urls.strip_www(F.lit("www.a.com")).alias("c"),
              urls.strip_www(F.lit("m.ab.com"), exact=True).alias("d"))
    assert tuple(row) == ("https://a.js", "/a.js", "a.com", ".com")


def test_hash_lanes_distance_and_bits(spark):
    rows = [("f" * 32, "0" * 32, 128), ("8" + "0" * 31, "0" * 32, 1), ("1", "0" * 31 + "3", 1),
            ("2c71711d2b23b26b881e00ffff7f3000", "2c71714d2b23b62b881e00ffff7f3400", 5)]
    got = values(spark, rows, "a string, b string, n int", bits.hamming("a", "b"), "n",
                 F.length(bits.hash_bits("a")), bits.hash_bits("a"))
    for (a, _, _), (d, n, size, text) in zip(rows, got):
        assert (d, size, text) == (n, 128, bin(int(a, 16))[2:].zfill(128))


def test_bands_cover_all_bits_once():
    for n in (7, 13, 14, 17):
        masks = [((h & (2**64 - 1)) << 64) | (lo & (2**64 - 1)) for h, lo in bits.band_masks(n)]
        assert sum(masks) == 2**128 - 1
        assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


def test_gradient_hash_by_hand(spark):
    grid = [(i * 37) % 101 for i in range(81)]
    row = [int(grid[y * 9 + x] < grid[y * 9 + x + 1]) for y in range(8) for x in range(8)]
    col = [int(grid[y * 9 + x] < grid[y * 9 + x + 9]) for y in range(8) for x in range(8)]
    want = "".join(f"{int(''.join(map(str, b)), 2):016x}" for b in (row, col))
    got = one(spark, bits.dhash(F.array(*[F.lit(float(g)) for g in grid])).alias("h")).h
    assert got == want


def test_payloads_and_tokens(spark):
    row = one(spark, fx.payload(F.lit('::JSON::"click"::JSON::'), "json").alias("a"),
              fx.payload(F.lit("<=V8 FUNCTION=> scriptID=21 (4,17) go"), "function").alias("b"),
              fx.payload(F.lit("<=V8 VALUE NULL=>"), "json").alias("c"),
              fx.is_missing_payload(F.lit("<=V8 VALUE UNDEFINED=> x")).alias("d"),
              fx.last_token(F.lit("12:00 Home URL: http://a/ \n")).alias("e"),
              fx.ignorable_url(F.lit('"about:blank"')).alias("f"),
              fx.parse_rank(F.lit(">30M")).alias("g"), fx.parse_rank(F.lit("17")).alias("h"),
              fx.round_down(F.lit(-5.0), 100).alias("i"))
    assert tuple(row) == ("click", "21 (4,17) go", None, True, "http://a/", True,
                          fixed.UNRANKED_VALUE, 17, -100)


def test_verdicts_reports_and_next_hops(spark):
    got = values(spark, [("None",), ("[SOCIAL_ENGINEERING]",), ("[MALWARE]",)], "r string",
                 F.col("r"), fx.verdict_flags("r"))
    assert [tuple(v) for _, v in got] == [
        (False, False, ""), (True, True, "[SOCIAL_ENGINEERING]"), (True, False, "[MALWARE]")]
    got = values(spark, [(None,), ("",), ('{"response_code":0}',),
                         ('{"response_code":1,"positives":3,"total":60}',)], "j string",
                 fx.report_fields("j"))
    assert [tuple(r[0]) for r in got] == [(None, None), (None, None), (-1, -1), (3, 60)]
    rows = [("redirect", 302, {"location": "http://b/"}, "x", ""),
            ("redirect", 200, {"location": "http://b/"}, "x", ""),
            ("meta_refresh", 200, {}, "x", '<a url=http://c/"</html>'),
            ("meta_refresh", 200, {}, "x", "no"), ("multiple_nojs_redirects", 200, {}, "x", ""),
            ("other", 200, {}, "x", "")]
    schema = "k string, s int, h map<string,string>, f string, b string"
    assert [r[0] for r in values(spark, rows, schema, fx.next_hop("k", "s", "h", "f", "b"))] == [
        "http://b/", None, "http://c/", None, "x", None]
    own = {"other": lambda s, h, f, b: F.concat(f, F.lit("!"))}
    assert values(spark, rows, schema, fx.next_hop("k", "s", "h", "f", "b", own))[-1] == ("x!",)
    ips = one(spark, fx.ipv4_answers(F.lit("a.b.\n1.2.3.4\n1.2.3\n")).alias("i")).i
    assert ips == ["1.2.3.4"]


def test_network_rules(spark):
    hexed = "/c9/05/36/c9053610c01d1356a73f9b4f736adce7.js"
    cases = [
        ("http://a/adServe/banners?tid=1", "RevenueHits"),
        ("http://a/banners/script/ui_tag_1.js", "RevenueHits"),
        ("http://a/script/rhpop_1.js", "RevenueHits"), ("http://a.popcash.net/", "PopCash"),
        ("http://a/prod/redirect.html?x", "AdCash"), ("http://a/prod/redirect.html", None),
        ("http://serve.popads.net/", "PopAds"), ("http://popmyads.com/", "PopMyAds"),
        (f"http://a{hexed}", "AdSterra"), (f"http://a{hexed.replace('c905', 'c906')}", None),
        ("http://hilltopads.net/", "HilltopAds"), ("http://a/out?vt=1", "HilltopAds"),
        ("http://a.clicksor.net/", "Clicksor"), ("http://d.cloudfront.net/?abcde=123456", "AdMaven"),
        ("http://d.cloudfront.net/?abcde=12345x", None),
        ("http://onclkds.com/apu.php", "Propeller"), ("http://moradu.com/apu.php", "Clickadu"),
        ("http://other.example.com/apu.php", None)]
    got = values(spark, [(u,) for u, _ in cases], "u string", network_of("u"))
    assert [g for g, in got] == [n for _, n in cases]
    assert one(spark, is_hex_triplet_path(F.lit(hexed)).alias("x")).x


def test_publisher_end_decides_the_network(spark):
    def node(u, kind="URL"):
        return ("f", kind, u, None, "r")
    chain = [node("http://land.example.com/"), node("http://a.popads.net/"),
             node("http://w.popcash.net/", "event_listener"), node("http://popmyads.com/x"),
             node("http://pub.example.com/")]
    df = spark.createDataFrame(
        [(1, chain), (2, chain[:1]), (3, [])],
        "id int, redirections array<struct<frame_id:string,kind:string,value:string,"
        "value2:string,reason:string>>")
    got = {r.id: (r.network, r.network_host) for r in identify_network(df).collect()}
    assert got == {1: ("PopMyAds", "popmyads.com"), 2: ("Unknown", None), 3: ("Unknown", None)}


def test_elements_and_sessions(spark):
    row = one(spark, fx.in_viewport(F.lit(5), F.lit(5), F.lit(1), F.lit(1), F.lit(10), F.lit(10))
              .alias("a"), fx.in_viewport(F.lit(5), F.lit(10), F.lit(1), F.lit(1), F.lit(10),
                                          F.lit(10)).alias("b"),
              fx.session_id(F.lit("h"), F.lit("c"), F.timestamp_micros(F.lit(5))).alias("s"))
    assert tuple(row) == (True, False, "h_c_5")
