"""Tracking, reputation, files, elements and streams on small fixtures."""

import itertools
import os
import random
import struct
import time
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from adtrail import fixed, schemas
from adtrail.operators import campaigns, elements, jobs, records, reputation, tracking
from adtrail.operators import cluster
from adtrail.operators.cluster import with_lanes
from adtrail.plans.select import nth_smallest
from adtrail.sources import files
from adtrail.streaming import streams

T0 = datetime(2024, 1, 1)


def near(n):
    return f"{(1 << n) - 1:032x}"


def apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


# --- tracking ------------------------------------------------------------------------------
def test_milking_urls_from_chains(spark):
    def node(u, kind="URL"):
        return ("f", kind, u, None, "r")
    rows = [
        ("1", "http://ad.com/", near(3), [node("http://ad.com/"), node("http://x.ad.com/"),
                                         node("t", "event_listener"), node("http://m.net/go"),
                                         node("http://up.org/"), node("http://ad.com/z")], 1),
        ("2", "http://ad.com/", near(3), [node("http://ad.com/"), node("http://m.net/other")], 2),
        ("3", "http://ad2.com/", fixed.ZERO_HASH, [node("http://ad2.com/"), node("http://only.net/")], 3),
        ("4", "http://ad3.com/", near(4), [], 4)]
    ads = spark.createDataFrame(
        rows, "log_id string, ad_url string, screenshot_hash string, "
        f"redirections array<{schemas.HOP}>, line_no int")
    got = tracking.milking_urls(ads, spark.createDataFrame([("com",)], "rule string"), ["line_no"])
    flat = {k: {tuple(r) for r in v.collect()} for k, v in got.items()}
    assert flat["milking_urls"] == {("m.net", "http://m.net/go")}
    assert flat["upstream_domains"] == {("up.org",), ("only.net",)}
    assert flat["ad_domains"] == {("ad.com",), ("ad2.com",), ("ad3.com",)}
    assert tuple(tracking.milking_summary(got).first()) == (3, 3, 1, 2, 6)


@pytest.mark.parametrize("block", [4096, 2])
def test_linkage_test_equals_all_pairs(spark, block):
    rng = random.Random(4)
    rows = []
    for g in range(30):
        base, spread = rng.getrandbits(128), rng.choice([2, 5, 7, 8, 40])
        for _ in range(rng.randint(1, 9)):
            h = base
            for _ in range(rng.randint(0, spread)):
                h ^= 1 << rng.randrange(128)
            rows.append((g, f"{h:032x}", rng.random() < .7, rng.random() < .7))
    rows = list({r[:2]: r for r in rows}.values())
    df = with_lanes(spark.createDataFrame(rows, "g int, h string, in_a boolean, in_b boolean"), "h")
    got = {r.g for r in tracking.linkage_exceeds(df, ["g"], 13, block=block).collect()}
    want = {a[0] for a, b in itertools.product(rows, rows)
            if a[0] == b[0] and a[2] and b[3] and apart(a[1], b[1]) > 13}
    assert got == want and want


def attempts(spark, rows):
    return spark.createDataFrame(
        [(*r, f"{r[0]}:{r[1]}") for r in rows],
        "agent string, url string, loaded_url string, image_hash string, job_name string")


def test_agents_that_see_the_same_are_dropped(spark):
    far = "f" * 32
    rows = [
        ("edge_win", "u1", "l", near(0)), ("chrome_mac", "u1", "l", near(13)), ("ie_win", "u1", "l", far),
        ("edge_win", "u2", "l", near(0)), ("chrome_mac", "u2", "l2", near(0)),
        ("chrome_mac", "u3", "l", near(14)), ("chrome_android", "u3", "l", near(0)),
        # kept edge_win removes chrome_mac, so ie_win is compared with edge_win only
        ("edge_win", "u4", "l", near(0)), ("chrome_mac", "u4", "l", near(10)), ("ie_win", "u4", "l", near(20)),
        # what both saw does not count; only hashes of the preferred agent alone do
        ("edge_win", "u5", "l", near(0)), ("edge_win", "u5", "l", far), ("ie_win", "u5", "l", far),
        ("ie_win", "u5", "l", near(0)), ("unknown_agent", "u5", "l", far)]
    got = {(r.url, r.agent) for r in tracking.dedupe_agents(attempts(spark, rows)).collect()}
    assert got == {("u1", "edge_win"), ("u1", "ie_win"), ("u2", "edge_win"), ("u2", "chrome_mac"),
                   ("u3", "chrome_mac"), ("u3", "chrome_android"), ("u4", "edge_win"), ("u4", "ie_win"),
                   ("u5", "edge_win")}


def test_funnel_counts_never_grow(spark):
    rows = [("edge_win", "http://a.com/1", "http://new.com/", near(0)),
            ("chrome_mac", "http://a.com/1", "http://new.com/", near(1)),
            ("edge_win", "http://b.com/1", "http://known.com/", near(0)),
            ("edge_win", "http://c.com/1", "http://new.com/", "f" * 32),
            ("edge_win", "http://d.com/1", "http://new.com/", near(5)),
            ("edge_win", "http://e.com/1", "http://new.com/", near(5))]
    att = attempts(spark, rows)
    sources = {"ad_domains": spark.createDataFrame([("known.com",)], "d string"),
               "image_hashes": spark.createDataFrame([(near(0),)], "h string"),
               "upstream_domains": spark.createDataFrame([("d.com",)], "d string")}
    expected = att.where("url <> 'http://e.com/1'").select("agent", "url")
    rules = spark.createDataFrame([("com",)], "rule string")
    kept, upstream, counts = tracking.milking_funnel(att, sources, expected, rules)
    assert [r.jobs for r in counts.orderBy("stage").collect()] == [6, 5, 4, 3, 2, 1]
    assert [tuple(r) for r in kept.collect()] == [("edge_win", "http://a.com/1")]
    assert {r.url for r in upstream.collect()} == {"http://d.com/1", "http://e.com/1"}
    lines = {tuple(r) for r in tracking.milk_sources(att, kept, upstream).collect()}
    assert lines == {("edge_win:http://a.com/1", None, "MILKING"),
                     ("edge_win:http://d.com/1", near(5), "UPSTREAM"),
                     ("edge_win:http://e.com/1", near(5), "UPSTREAM")}


def test_small_set_functions(spark):
    df = spark.createDataFrame([([near(0), near(9)], [near(9), near(13)]), ([near(0)], [near(14)])],
                               "a array<string>, b array<string>")
    got = df.select(tracking.sets_similar(F.col("a"), F.col("b")).alias("s"),
                    tracking.same_set(F.col("a"), F.col("b")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False)]


# --- reputation ----------------------------------------------------------------------------
def verdict_log(spark):
    h = [T0 + timedelta(hours=i) for i in range(6)]
    rows = [("late", h[0], "None"), ("late", h[2], "[MALWARE]"), ("late", h[4], "None"),
            ("never", h[1], "None"), ("never", h[3], "None"), ("once", h[5], "[SOCIAL_ENGINEERING]")]
    return spark.createDataFrame(rows, "domain string, query_time timestamp, result string")


def test_verdicts_freeze_at_the_first_flag(spark):
    state = reputation.verdict_state(verdict_log(spark))
    got = {r.domain: (r.first_flag, r.last_flag, r.last_query_time.hour, r.last_result)
           for r in state.collect()}
    assert got == {"late": (False, True, 2, "[MALWARE]"), "never": (False, False, 3, ""),
                   "once": (True, True, 5, "[SOCIAL_ENGINEERING]")}
    assert [(r.domain, r.lag) for r in reputation.detection_lag(state).collect()] == [
        ("late", timedelta(hours=2))]
    stats = reputation.detection_lag_stats(state).first()
    assert (stats.domains, stats.mean_seconds, stats.median_seconds) == (1, 7200.0, 7200.0)
    known = spark.createDataFrame([("late",), ("never",), ("new",)], "domain string")
    table = reputation.verdict_table(known, verdict_log(spark))
    assert {r.domain for r in reputation.queryable(table).collect()} == {"never", "new"}
    unfrozen = reputation.verdict_state(verdict_log(spark), freeze=False)
    assert {r.domain for r in unfrozen.where("last_flag").collect()} == {"once"}


def test_not_in_with_and_without_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "d string")
    for other, want in (([("a",)], ["b"]), ([("a",), (None,)], []), ([], ["a", "b", None])):
        o = spark.createDataFrame(other, "x string")
        got = [r.d for r in reputation.not_in(df, "d", o, "x").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


# --- campaigns -----------------------------------------------------------------------------
def test_a_hash_counts_once_in_the_first_category(spark):
    schema = "label int, screenshot_hash string, ad_url string, seed_domain string"
    members = spark.createDataFrame([
        (1, "h1", "http://a.com/", "p1"), (2, "h1", "http://b.com/", "p2"),
        (2, "h2", "http://c.com/", "p3"), (3, "h9", "http://d.com/", "p4")], schema)
    all_ads = spark.createDataFrame([
        (0, "h1", "http://a.com/", "p1"), (0, "h1", "http://b.com/", "p2"),
        (0, "h1", "http://e.com/", "p5"), (0, "h2", "http://c.com/", "p3")], schema)
    cmap = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "category string, label int")
    threat = spark.createDataFrame([("e.com",), ("d.com",)], "d string")
    got = {r.category: tuple(r)[1:] for r in campaigns.campaign_table(
        members, cmap, all_ads, threat).collect()}
    assert got == {"x": (3, 3, 1, 1, 3), "y": (2, 2, 2, 1, 1), "total": (5, 5, 3, 2, 5)}


def test_popularity_and_ranks(spark):
    seeds = files.parse_seeds(spark.createDataFrame(
        [("a.com;1000", "l"), ("b.com;>30M", "l"), ("a.com;7", "m"), ("bad", "l")],
        "value string, list string"))
    ranks = jobs.popularity_ranks(seeds)
    pubs = spark.createDataFrame([("a.com",), ("b.com",), ("z.com",)], "domain string")
    got = {r.tier: (r.publishers, r.unranked) for r in campaigns.popularity_tiers(pubs, ranks).collect()}
    assert got[1000] == (1, 1) and got[30_000_000] == (1, 1) and got[31_000_000] == (2, 1)
    res, rest = jobs.split_vantage(seeds, ["m"])
    assert {tuple(r) for r in rest.collect()} == {("a.com", 1000), ("b.com", 30_000_000)}
    assert [tuple(r) for r in res.collect()] == [("a.com", 7)]


# --- files ---------------------------------------------------------------------------------
def test_ads_round_trip(spark, tmp_path):
    line = ('{"log_id":"s1","screenshot":"a.png","screenshot_hash":"' + near(5) + '","' + fixed.AD_LOG_FIELD + '":"l",'
            '"redirections":[[["0x1","URL","http://a.example.com/[x]"],"JS Navigation"],'
            '[["0x1","event_listener",["t:1 \\"q\\"","click"]],"FIRST"]],"home_url":"h","ad_url":"u"}\n')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1.txt").write_text(line * 2)
    ads = files.read_ads(spark, str(tmp_path / "in"))
    files.write_ads(ads, str(tmp_path / "out"))
    again = files.read_ads(spark, str(tmp_path / "out"))
    for df in (ads, again):
        rows = df.collect()
        assert len(rows) == 2 and rows[0].event_log == "l"
        assert [tuple(h) for h in rows[0].redirections] == [
            ("0x1", "URL", "http://a.example.com/[x]", None, "JS Navigation"),
            ("0x1", "event_listener", 't:1 "q"', "click", "FIRST")]


def test_downloads_are_keyed_by_content(spark, tmp_path):
    for name, body in (("a.bin", b"1"), ("b.bin", b"1"), ("c.bin", b"2")):
        (tmp_path / name).write_bytes(body)
    got = {r.name for r in files.hash_files(spark, str(tmp_path)).collect()}
    assert got == {"a.bin", "c.bin"}
    old = time.time() - 1000
    os.utime(tmp_path / "a.bin", (old, old))
    quiet = files.quiet_files(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in quiet] == ["a.bin"]


def png(path, rows):
    """Write 8-bit grey rows as a PNG file."""
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    data = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data)
                     + chunk(b"IEND", b""))


def test_screenshots_are_read_and_hashed(spark, tmp_path):
    png(tmp_path / "ramp.png", [[x * 5 for x in range(45)] for _ in range(30)])
    png(tmp_path / "plain.png", [[7] * 20 for _ in range(20)])
    png(tmp_path / "down.png", [[y * 10] * 18 for y in range(18)])
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.screenshot: r.screenshot_hash for r in files.read_screenshots(spark, str(tmp_path)).collect()}
    assert got == {"ramp.png": "f" * 16 + "0" * 16, "plain.png": fixed.ZERO_HASH,
                   "down.png": "0" * 16 + "f" * 16}


def test_images_are_shrunk_by_area_means():
    grid = files._shrink(bytes(range(0, 180, 10)) * 18, 18, 18, 1, 9)
    assert len(grid) == 81 and grid[0] == 5.0 and grid[8] == 165.0
    colour = files._shrink(bytes([10, 20, 30]) * 100, 10, 10, 3, 9)
    assert np.allclose(colour, 10 * .114 + 20 * .587 + 30 * .299)


def test_dicts_results_and_splits(spark, tmp_path):
    pairs = spark.createDataFrame([("1", 4), ("1", 2), ("2", 3)], "k string, v int")
    back = files.parse_dict(files.dict_json(pairs, "k", "v"), "array<int>")
    assert {tuple(r) for r in back.collect()} == {("1", 2), ("1", 4), ("2", 3)}
    results = spark.createDataFrame([("1.5", "res"), ("x", "non")], "total_time string, ip_type string")
    files.append_results(results, str(tmp_path / "r"))
    files.append_results(results, str(tmp_path / "r"))
    read = files.read_job_results(spark, str(tmp_path / "r"))
    assert read.count() == 4 and read.agg(F.sum("total_time")).first()[0] == 3.0
    assert {p for p in os.listdir(tmp_path / "r") if "=" in p} == {"ip_type=res", "ip_type=non"}
    big = spark.range(50).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    lines = files.dict_json(big, "k", "v", per_line=10)
    assert lines.count() > 1 and files.parse_dict(lines, "array<int>").distinct().count() == 50
    parts = files.split_round_robin(spark.range(10), 3, ["id"]).orderBy("id").collect()
    assert [r.part for r in parts] == [i % 3 for i in range(10)]
    files.write_table(pairs, "t", folder=str(tmp_path))
    assert files.read_table(spark, "t", folder=str(tmp_path)).count() == 3


# --- elements ------------------------------------------------------------------------------
def brute_diverse(rows):
    """rows of one page: (elem_id, x, y, h, w, preferred)."""
    order = sorted(rows, key=lambda r: (not (r[5] and r[3] * r[4] > 900), -r[3] * r[4], r[0]))
    kept = []
    for e in order:
        if any((k[3], k[4]) == (e[3], e[4]) for k in kept):
            continue
        if any((k[1] // 100, k[2] // 100) == (e[1] // 100, e[2] // 100) for k in kept):
            continue
        if sum(k[2] == e[2] for k in kept) >= 2:
            continue
        kept.append(e)
    return [e[0] for e in kept[:20]]


@pytest.mark.parametrize("prefix", [1000, 7])
def test_diverse_elements_equal_the_greedy_choice(spark, prefix):
    rng = random.Random(9)
    rows = [(p, i, float(rng.randrange(0, 1500)), float(rng.randrange(0, 12) * 80),
             float(rng.randrange(1, 60)), float(rng.randrange(1, 60)), rng.random() < .3)
            for p, n in ((1, 300), (2, 40), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, elem_id long, mid_x double, mid_y double, "
                               "h double, w double, preferred boolean")
    got = {}
    for r in elements.diverse_elements(df, prefix=prefix).orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append(r.elem_id)
    want = {p: brute_diverse([r[1:] for r in rows if r[0] == p]) for p in (1, 2, 3)}
    assert got == want


# --- streams -------------------------------------------------------------------------------
def written(df, path, batches):
    """One file per batch, read back one file at a time."""
    spark = df.sparkSession
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_seen_across_batches(spark, tmp_path):
    df = spark.createDataFrame([], "domain string, file_hashes array<string>")
    batches = [[("a", ["1", "2"]), ("a", ["2"])], [("b", []), ("a", ["3"])], [("b", ["1"])]]
    stream = written(df, str(tmp_path / "s"), batches)
    assert sorted(r.domain for r in streams.run_available(
        streams.first_seen_stream(stream.select("domain"), ["domain"])).collect()) == ["a", "b"]
    assert sorted(r.file_hash for r in streams.run_available(
        streams.first_seen_files(stream)).collect()) == ["1", "2", "3"]


def test_verdict_stream_equals_batch_whatever_the_order(spark, tmp_path):
    log = verdict_log(spark)
    rows = [tuple(r) for r in log.collect()]
    random.Random(1).shuffle(rows)
    stream = written(log, str(tmp_path / "s"), [rows[:2], rows[2:3], rows[3:]])
    got = streams.run_available(streams.verdict_stream(stream), "complete",
                                finish=reputation.unpack_verdicts)
    want = reputation.verdict_state(log)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_ingest_drops_incomplete_results(spark, tmp_path):
    df = spark.createDataFrame([], "job_name string, image_hash string")
    stream = written(df, str(tmp_path / "s"), [[("j", "h"), (None, "h")], [("k", None)]])
    rows = streams.run_available(streams.ingest_results(stream, ["job_name", "image_hash"])).collect()
    assert [r.job_name for r in rows] == ["j"] and rows[0].received_at is not None


def test_retry_batches_hand_on_what_has_no_answer(spark, tmp_path):
    df = spark.createDataFrame([], "file_hash string")
    stream = written(df, str(tmp_path / "s"), [[("1",), ("2",)], [("3",), ("2",)]])
    answered = spark.createDataFrame([("2",)], "file_hash string")
    seen = []
    streams.retry_batches(stream, lambda: answered, "file_hash",
                          lambda b, n: seen.extend(r.file_hash for r in b.collect()),
                          str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == ["1", "3"]


def test_complete_mode_without_any_batch_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "s").mkdir()
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "s"))
    out = streams.run_available(streams.insert_absent_stream(stream, ["k"]), "complete")
    assert out.count() == 0 and out.columns == ["k", "first_seen"]


@pytest.mark.parametrize("buckets", [2, 4096])
def test_selection_by_rank(spark, buckets):
    rng = random.Random(buckets)
    values = [rng.choice([-2**63, 2**63 - 1, 7, 7, rng.randrange(-10**15, 10**15), None]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ranked = sorted(v for v in values if v is not None)
    for nth in (1, 2, len(ranked) // 2, len(ranked)):
        assert nth_smallest(df, "v", nth, buckets) == ranked[nth - 1]
    assert nth_smallest(df, "v", len(ranked) + 1) is None and nth_smallest(df.limit(0), "v", 1) is None


def test_repeated_ads_do_not_make_a_cluster(spark):
    rows = [(f"l{i}", "one.com", near(0), i) for i in range(5)] + [("m", "two.com", near(3), 9)]
    rows += [(f"n{i}", f"d{i}.com", "f" * 32, 20 + i) for i in range(3)]
    ads = spark.createDataFrame(rows, "log_id string, domain string, screenshot_hash string, line_no int")
    got = {r.log_id: r.label for r in cluster.discover(ads, order_by=["line_no"]).collect()}
    assert got == {"l0": -1, "m": -1, "n0": 0, "n1": 0, "n2": 0}


def test_a_batch_writes_only_the_keys_it_changed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", 1), ("b", 2), (None, 3)], [("b", 1), ("c", 9)], [("c", 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, ts long").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    stream = spark.readStream.schema("k string, ts long").option("maxFilesPerTrigger", 1).parquet(source)
    table = streams.run_updates(streams.observe_stream(stream, ["k"]), ["k"], folder=out)
    got = {r.k: (r["count"], r.first_seen, r.last_seen) for r in table.collect()}
    assert got == {"a": (1, 1, 1), "b": (2, 1, 2), "c": (2, 5, 9), None: (1, 3, 3)}
    written = {r.batch: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert written == {0: 3, 1: 2, 2: 1}


def test_only_rows_whose_wait_is_over_are_unanswered(spark, tmp_path):
    at = [T0 + timedelta(minutes=i) for i in range(200)]
    seen = [("in time", at[0]), ("late answer", at[1]), ("none", at[2]), (None, at[3]), ("still open", at[150]), ("x", at[190])]
    answers = [("in time", at[10]), ("late answer", at[90]), ("none", at[1]), ("y", at[190]), (None, at[4])]
    for name, rows, column in (("s", seen, "seen_at"), ("a", answers, "answered_at")):
        spark.createDataFrame(rows, f"k string, {column} timestamp").write.parquet(str(tmp_path / name))
    read = lambda n, c: spark.readStream.schema(f"k string, {c} timestamp").parquet(str(tmp_path / n))
    out = streams.run_available(streams.unanswered_stream(read("s", "seen_at"), read("a", "answered_at"), "k", "1 hour"))
    assert {r.k for r in out.collect()} == {"late answer", "none", None}


def test_a_landing_page_without_host_counts_but_is_not_looked_up(spark):
    ads = spark.createDataFrame([(1, "h", "", "pub"), (1, "h", "http://bad.com/", "pub")],
                                "label int, screenshot_hash string, ad_url string, seed_domain string")
    groups = spark.createDataFrame([("c", 1)], "category string, label int")
    for threat, flagged in (("", 0), ("bad.com", 1)):
        table = campaigns.campaign_table(ads, groups, ads, spark.createDataFrame([(threat,)], "d string"))
        row, = table.where("category = 'c'").collect()
        assert (row.attacks, row.landing_domains, row.flagged_clusters, row.publishers) == (2, 2, flagged, 1)
