"""Event records, causal edges and the walk, on small literal logs."""

import random

import pytest
from pyspark.sql import functions as F

from adtrail import fixed, schemas
from adtrail.functions import fields as fx
from adtrail.operators import chains, records
from adtrail.plans import jumps
from adtrail.plans.jumps import walks
from adtrail.sources import logs

BLANK = "about:blank"


def record(name, extra="", **fields):
    body = "".join(f"{fixed.RECORD_PREFIX}{k}={v}\n" for k, v in fields.items())
    return f"LOG::Page::{name} :\n{body}{extra}{fixed.RECORD_END}\n"


def arg(name, value):
    return f"{fixed.RECORD_PREFIX}arg_name={name}\n{fixed.RECORD_PREFIX}arg_value={value}\n"


def page(frame, url="http://home.example.com/", main="m"):
    return dict(frame=frame, main_frame=main, frame_url=url, local_frame_root=main,
                local_frame_root_url="http://home.example.com/")


def read(spark, tmp_path, text, name="s1.log"):
    (tmp_path / name).write_text(text)
    return logs.read_event_log(spark, str(tmp_path))


def edges_of(spark, tmp_path, *parts):
    events = logs.event_columns(read(spark, tmp_path, "".join(parts)))
    return chains.derive_edges(events)


def shown(edges):
    return {(r.dst.kind, r.dst.value, r.dst.value2, r.src.kind, r.src.value, r.reason)
            for r in edges.collect()}


def test_record_parsing(spark, tmp_path):
    p = fixed.RECORD_PREFIX
    text = (f"noise\nLOG::V8::DidCompileScript :\n{p}frame= 0x1 \n{p}no separator\n{p}frame=0x2\n"
            f"{p}code=a = 1;\n  b = 2;\n{p}{arg('type', 'x')[len(p):]}{arg('type', 'y')}"
            f"{p}attr_name=\"id\"\n{p}attr_value=\"q=1\"\n{fixed.RECORD_END}\n"
            f"LOG::V8::Other :\n{p}arg_name=a\n{fixed.RECORD_END}\n")
    first, second = read(spark, tmp_path, text).orderBy("seq").collect()
    assert first.log_id == "s1" and first.header == "LOG::V8::DidCompileScript :"
    assert first.fields == {"frame": "0x2", "code": "a = 1;\n  b = 2;"}
    assert first.args == {"type": "y"} and first.attrs == {"id": "q=1"} and not first.malformed
    assert second.malformed


def test_older_dialect_downloads_and_bridge(spark, tmp_path):
    text = ("LOG::Forensics::DownloadManagerImpl::StartDownload :\n  guid=g1\n  url=http://a/\n"
            "  url=http://b/\n  total_bytes=12\n  has_user_gesture=1\n---\n"
            "LOG::Forensics::GinJavaBridgeDispatcherHost::OnInvokeMethod :\n  routing_id=1\n"
            "  object_id=3\n  method_name=go\n  method_args=::JSON::[\"x\"]::JSON::\n---\n")
    (tmp_path / "d.log").write_text(text)
    events = logs.read_event_log(spark, str(tmp_path), "v1")
    d, = records.downloads(events).collect()
    assert (d.guid, d.urls, d.total_bytes, d.has_user_gesture) == (
        "g1", ["http://a/", "http://b/"], 12, True)
    b, = records.bridge_calls(events).collect()
    assert (b.call, b.object_id, b.method_name, b.method_args) == (
        "OnInvokeMethod", 3, "go", '["x"]')


def test_adjacent_duplicates_ignore_the_timestamp(spark, tmp_path):
    text = (record("A", frame=1, timestamp=1) + record("A", frame=1, timestamp=2)
            + record("B", frame=1, timestamp=3) + record("A", frame=1, timestamp=4))
    bodies = records.record_body(read(spark, tmp_path, text))
    kept = records.drop_adjacent_duplicates(bodies, ["body"])
    assert [r.fields["timestamp"] for r in kept.orderBy("seq").collect()] == ["1", "3", "4"]
    loose = records.record_body(read(spark, tmp_path, text), compare_header=False)
    assert records.drop_adjacent_duplicates(loose, ["body"]).count() == 1


def test_plain_edges_and_their_guard(spark, tmp_path):
    got = edges_of(
        spark, tmp_path,
        record("DidReceiveMainResourceRedirect", frame="m", request_url="http://b/", redirect_url="http://a/"),
        record("DidReceiveMainResourceRedirect", frame="m", request_url="http://b/", redirect_url="http://b/"),
        record("DidReceiveMainResourceRedirect", frame="m", request_url="http://c/", redirect_url=BLANK),
        record("DidHandleHttpRefresh", refresh_url="http://d/", **page("f", BLANK)),
        record("WillLoadFrame", load_url="http://e/", **page("f", "http://f/")),
        record("DidCallV8MethodCallback", interface="History", attribute="pushState", **page("m", "http://g/")),
        record("DidCallV8MethodTemplate", interface="History", attribute="pushState", **page("m", "http://h/")),
        record("DidCallV8MethodTemplate", interface="History", attribute="pushState", **page("m", "http://i/")))
    assert shown(got) == {
        ("URL", "http://b/", None, "URL", "http://a/", "Server Redirect"),
        ("URL", "http://d/", None, "URL", "http://home.example.com/", "Meta Refresh"),
        ("URL", "http://e/", None, "URL", "http://f/", "Frame Load"),
        ("URL", "http://e/", None, "URL", "http://f/", "Load Frame"),
        ("URL", "http://h/", None, "URL", "http://g/", "History Push State")}


def listener_log():
    v8 = "<=V8 FUNCTION=> scriptID=7 (1,2) go"
    return [
        record("DidCompileScript", scriptID=7, url="http://s.example.com/s.js", **page("m")),
        record("DidCallV8MethodTemplate", interface="EventTarget", attribute="addEventListener",
               cpp_impl_ptr="t1", extra=arg("type", '::JSON::"click"::JSON::') + arg("listener", v8),
               **page("m")),
        record("DidCallV8MethodTemplate", interface="Window", attribute="setTimeout",
               extra=arg("handler", '::JSON::"go()"::JSON::'), **page("m")),
        record("RequestAnimationFrame", callback_id=4, **page("m")),
        record("DidCallV8SetAttribute", interface="HTMLAnchorElement", attribute="href",
               value='::JSON::"http://link/"::JSON::', **page("m")),
        record("DidInsertDOMNode", node="SCRIPT", src_url="//cdn.example.com/x.js", **page("m")),
        record("DidCallV8SetAttributeEventListener", attribute="onload", cpp_impl_ptr="t2",
               scriptID=7, callback_debug_name="(3,4)", **page("m")),
        record("DidRunCompiledScriptEnd", **page("m")),
        record("WillNavigateFrame", url="http://nobody/", origin_frame="m", **page("m")),
        record("DidCallHandleEventBegin", current_target="t1", event="click", **page("k")),
        record("DidCallFunctionBegin", scriptID="7 (1,2)", callback_debug_name="go", **page("k")),
        record("DidCallFunctionBegin", scriptID="9", callback_debug_name="inner", **page("k")),
        record("WillNavigateFrame", url="http://ad/", origin_frame="k", **page("k", main="k")),
        record("DidCallHandleEventEnd", current_target="t1", **page("k")),
        record("DidFireScheduledActionBegin", code="go()", **page("m")),
        record("WillNavigateFrame", url="http://timed/", origin_frame="m", **page("m")),
        record("DidFireScheduledActionEnd", code="go()", **page("m")),
    ]


def test_edges_from_running_code_and_the_walk_across_frames(spark, tmp_path):
    edges = edges_of(spark, tmp_path, *listener_log())
    script = ("URL", "http://s.example.com/s.js")
    assert shown(edges) == {
        ("URL", "http://s.example.com/s.js", None, "URL", "http://home.example.com/", "Script Load"),
        ("event_listener", "t1:7 (1,2) go", "click", *script, "click_listener"),
        ("scheduled_action", "code", "go()", *script, "scheduled_action"),
        ("request_animation_frame", "4", None, *script, "animation_callback"),
        ("URL", "http://link/", None, *script, "Anchor link setup - set att"),
        ("URL", "http://cdn.example.com/x.js", None, *script, "Dynamic Script Load"),
        ("event_listener", "t2:7 (3,4)", "load", *script, "on_load_listener"),
        ("URL", "http://ad/", None, "event_listener", "t1:7 (1,2) go", "JS Navigation"),
        ("URL", "http://timed/", None, "scheduled_action", "code", "JS Navigation")}
    targets = spark.createDataFrame([("s1", "http://ad/"), ("s1", "http://none/")],
                                    "log_id string, ad_url string")
    chain, = chains.redirect_chains(chains.resolve_edges(edges), targets).collect()
    # the listener ran in another frame than it was added in
    assert [(h.node.value, h.reason) for h in chain.chain] == [
        ("http://ad/", "JS Navigation"), ("t1:7 (1,2) go", "click_listener"),
        ("http://s.example.com/s.js", "Script Load"), ("http://home.example.com/", "FIRST")]


def test_window_open_link_click_and_unknown_inserts(spark, tmp_path):
    script = record("DidCompileScript", scriptID=1, url="http://s/", **page("m"))
    got = shown(edges_of(
        spark, tmp_path, script,
        record("DidCallV8SetAttribute", interface="HTMLAnchorElement", attribute="href",
               value='::JSON::"http://link/"::JSON::', **page("m")),
        record("WindowOpen", **page("m")),
        record("WillLoadFrame", load_url="http://pop/", **page("p1", BLANK, "p1")),
        record("WindowOpen", **page("m")),
        record("WillLoadFrame", load_url="http://link/", **page("p2", BLANK, "p2")),
        record("DidInsertDOMNode", node="HTML", **page("p3")),
        record("WillLoadFrame", load_url="http://link/", **page("p3", "http://x/", "p3")),
        record("DidRunCompiledScriptEnd", **page("m"))))
    assert ("URL", "http://pop/", None, "URL", "http://s/", "Window Open") in got
    assert ("URL", "http://link/", None, "URL", "http://link/", "Anchor link click") in got
    assert ("URL", "http://link/", None, "URL", "http://x/", "Load Frame") in got
    assert not any(r[-1].endswith("unknown") for r in got)    # its source is a real page


def test_ends_that_do_not_fit_are_ignored(spark, tmp_path):
    """A script End inside a handler leaves the script open; so does an End of another timer."""
    text = "".join([
        record("DidCompileScript", scriptID=1, url="http://s/", **page("m")),
        record("DidFireScheduledActionBegin", code="a", **page("m")),
        record("DidRunCompiledScriptEnd", **page("m")),
        record("WillNavigateFrame", url="http://1/", origin_frame="m", **page("m")),
        record("DidFireScheduledActionEnd", code="b", **page("m")),
        record("WillNavigateFrame", url="http://2/", origin_frame="m", **page("m")),
        record("DidFireScheduledActionEnd", code="a", **page("m")),
        record("WillNavigateFrame", url="http://3/", origin_frame="m", **page("m")),
        record("DidRunCompiledScriptEnd", **page("m")),
        record("WillNavigateFrame", url="http://4/", origin_frame="m", **page("m"))])
    got = {d: (k, s) for _, d, _, k, s, why in shown(edges_of(spark, tmp_path, text))
           if why == "JS Navigation"}
    assert got == {"http://1/": ("scheduled_action", "code"),
                   "http://2/": ("scheduled_action", "code"), "http://3/": ("URL", "http://s/")}


def test_child_frames_share_their_parents_runner(spark, tmp_path):
    got = shown(edges_of(
        spark, tmp_path, record("DidCreateChildFrame", frame="m", child_frame="c"),
        record("DidCreateChildFrame", frame="c", child_frame="g"),
        record("DidCompileScript", scriptID=1, url="http://s/", **page("m")),
        record("WillNavigateFrame", url="http://deep/", origin_frame="g", **page("g", main="g")),
        record("WillNavigateFrame", url="http://away/", origin_frame="z", **page("z", main="z")),
        record("DidRunCompiledScriptEnd", **page("m"))))
    assert ("URL", "http://deep/", None, "URL", "http://s/", "JS Navigation") in got
    assert not any(r[1] == "http://away/" for r in got)


def test_edge_policy(spark):
    def row(dst, src, policy, seq):
        return ("s", ("f", "URL", dst, None), ("f", "URL", src, None), src, seq, policy)
    df = spark.createDataFrame([
        row("a", "first", 1, 1), row("a", "second", 1, 2), row("a", "resort", 2, 0),
        row("b", "over1", 0, 1), row("b", "first", 1, 0), row("b", "over2", 0, 3), row("b", "late", 1, 9),
        row("c", "resort1", 2, 1), row("c", "resort2", 2, 2)], schemas.EDGES)
    got = {r.dst.value: r.src.value for r in chains.resolve_edges(df).collect()}
    assert got == {"a": "first", "b": "over2", "c": "resort2"}


def brute_walk(nxt, start, load, limit):
    out, key, i = [], start, 0
    while key in nxt:
        i += 1
        src, why = nxt[key]
        if (key, why) in out:
            break
        out.append((key, why))
        key = src
        if key == load or i == limit:
            break
    return out + [(key, "FIRST")]


@pytest.mark.parametrize("limit", [4, 30])
def test_walk_equals_brute_force_with_cycles_and_long_chains(spark, limit):
    rng = random.Random(2)
    nxt = {f"u{i}": (f"u{rng.randrange(60)}" if i % 9 else f"u{i + 1}", f"r{i % 3}") for i in range(55)}
    nxt.update({f"l{i}": (f"l{i + 1}", "r") for i in range(50)})
    node = [fx.node(F.lit("f"), F.lit("URL"), F.col(c)).alias(n) for c, n in (("d", "dst"), ("s", "src"))]
    edges = spark.createDataFrame([(k, s, w, i) for i, (k, (s, w)) in enumerate(nxt.items())],
                                  "d string, s string, reason string, seq long").select(
        F.lit("log").alias("log_id"), *node, "reason", "seq", F.lit(1).alias("policy"))
    targets = spark.createDataFrame([("log", k, "u7") for k in [*nxt, "nowhere"]],
                                    "log_id string, ad_url string, load_url string")
    got = {r.ad_url: [(h.node.value, h.reason) for h in r.chain] for r in chains.redirect_chains(
        chains.resolve_edges(edges), targets, limit=limit).collect()}
    assert got == {k: brute_walk(nxt, k, "u7", limit) for k in nxt}
    assert max(len(c) for c in got.values()) == limit + 1


def test_url_chains_end_on_cycles(spark):
    edges = spark.createDataFrame(
        [("s", "a", "b", "x", 1), ("s", "b", "c", "y", 2), ("s", "c", "a", "z", 3), ("s", "a", "q", "w", 4)],
        "log_id string, dst_url string, src_url string, reason string, seq long")
    targets = spark.createDataFrame([("s", "a")], "log_id string, ad_url string")
    chain, = chains.url_chains(edges, targets).collect()
    assert [(h.node.value, h.reason) for h in chain.chain] == [
        ("a", "x"), ("b", "y"), ("c", "z"), ("a", "")]


def test_walks_without_a_limit(spark):
    """Ends, rings of several sizes, tails into rings, and walks of 10,000 hops."""
    rng = random.Random(6)
    to = {i: rng.choice([None, rng.randrange(300), i + 1]) for i in range(300)}
    to |= {i: i + 1 for i in range(1000, 11_000)} | {11_000: None, 500: 500, 501: 502, 502: 501}
    links = spark.createDataFrame(list(to.items()), "n long, to long")
    begin = [*range(0, 300, 3), 500, 501, 1000, 5000, 11_000]
    starts = spark.createDataFrame([(i, n) for i, n in enumerate(begin)], "walk long, n long")
    got = {}
    for r in walks(starts, links).orderBy("walk", "pos").collect():
        got.setdefault(r.walk, []).append(r.n)
    for i, n in enumerate(begin):
        path = []
        while n is not None and n not in path[-1000:]:
            path.append(n)
            n = to.get(n)
        assert got[i] == path + ([n] if n is not None else [])
    short = walks(starts, links, 5).groupBy("walk").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("p")).collect()
    assert all(r.n == r.p + 1 <= 5 for r in short) and max(r.n for r in short) == 5
    assert walks(starts, links.where("to is null")).count() == len(begin)


def test_url_chain_of_ten_thousand_hops(spark):
    n = 10_000
    edges = spark.range(n).select(F.lit("s").alias("log_id"), F.concat(F.lit("u"), F.col("id")).alias("dst_url"),
                                  F.concat(F.lit("u"), F.col("id") + 1).alias("src_url"), F.lit("r").alias("reason"),
                                  F.col("id").alias("seq"))
    targets = spark.createDataFrame([("s", "u0"), ("s", f"u{n - 2}")], "log_id string, ad_url string")
    got = {r.ad_url: [h.node.value for h in r.chain] for r in chains.url_chains(edges, targets).collect()}
    assert got == {"u0": [f"u{i}" for i in range(n + 1)], f"u{n - 2}": [f"u{i}" for i in range(n - 2, n + 1)]}


def test_a_listener_of_another_frame_may_lead_round_once_more(spark):
    def node(frame, kind, value, value2=None):
        return (frame, kind, value, value2)
    a, x, y = node("f", "URL", "a"), node("g", "event_listener", "t", "e"), node("f", "event_listener", "t", "e")
    rows = [("s", a, x, "one", 1, 1), ("s", y, a, "two", 2, 1)]
    edges = chains.resolve_edges(spark.createDataFrame(rows, schemas.EDGES))
    targets = spark.createDataFrame([("s", "a")], "log_id string, ad_url string")
    for limit in (30, None):
        chain, = chains.redirect_chains(edges, targets, limit).collect()
        assert [(h.node.value, h.node.frame_id, h.reason) for h in chain.chain] == [
            ("a", "f", "one"), ("t", "g", "two"), ("a", "f", "FIRST")]


def test_session_logs(spark, tmp_path):
    (tmp_path / "s9.log").write_text("\n".join([
        "t:Screenshot: of URL /h/home.png", f"t {fixed.EVENT_LOG_MARKER}one.txt",
        "t:3rd party page URL: http://a/", "html", "t:Screenshot: /x/a.png",
        "t:3rd party page URL: http://b/", "t:Screenshot: /x/b.png",
        f"t {fixed.EVENT_LOG_MARKER}two.txt", "t:3rd party page URL: http://c/", "html",
        "t:Screenshot: /x/c.png", "Home URL: http://h1/", "Home URL: http://h2/",
        "The screenshot of loaded home page /x/home.png", "Downloaded a file: f"]))
    lines = logs.read_sessions(spark, str(tmp_path))
    got = [(r.ad_url, r.screenshot, r.event_log, r.home_url)
           for r in records.session_ads(lines).orderBy("line_no").collect()]
    # the second log file is named in a line that is read along with the second page
    assert got == [("http://a/", "a.png", "one.txt", "/h/home.png"),
                   ("http://c/", "c.png", "one.txt", "/h/home.png")]
    assert [r.ad_url for r in records.session_ads(lines, gap=1).collect()] == ["http://b/"]
    out, = records.session_outcome(lines).collect()
    assert (out.screenshot_path, out.loaded_url, out.downloaded_files) == (
        "/x/home.png", "http://h2/", True)


@pytest.mark.parametrize("gap", [1, 2, 3])
def test_lines_read_with_a_page_count_for_nothing_else(spark, gap):
    rng = random.Random(gap)
    kinds = {"page": "t:3rd party page URL: http://p{}/", "shot": "t:Screenshot: /x/s{}.png", "log": f"t {fixed.EVENT_LOG_MARKER}l{{}}.txt",
             "home": "t:Screenshot: of URL /h{}.png", "other": "t nothing {}"}
    sessions = {f"s{j}": [kinds[rng.choice(["page", "page", *kinds])].format(i) for i in range(rng.choice([1, 8, 60]))]
                for j in range(40)}
    want = set()
    for name, lines in sessions.items():
        home = log = None
        i = 0
        while i < len(lines):
            token = lines[i].split(" ")[-1]
            if home is None and ":Screenshot: " in lines[i] and "URL" in lines[i]:
                home = token
            if fixed.EVENT_LOG_MARKER in lines[i]:
                log = token
            step = 1
            if "page URL" in lines[i]:
                if i + gap < len(lines) and ":Screenshot: " in lines[i + gap]:
                    want.add((name, i + 1, token, lines[i + gap].split("/")[-1], log, home))
                step = gap + 1
            i += step
    df = spark.createDataFrame([(n, i + 1, x) for n, ls in sessions.items() for i, x in enumerate(ls)],
                               "log_id string, line_no long, line string")
    got = {(r.log_id, r.line_no, r.ad_url, r.screenshot, r.event_log, r.home_url)
           for r in records.session_ads(df, gap).collect()}
    assert got == want and len(want) > 20


def test_malformed_records_make_no_edges(spark, tmp_path):
    good = record("DidReceiveMainResourceRedirect", frame="m", request_url="http://b/", redirect_url="http://a/")
    broken = good.replace("http://b/", "http://c/").replace(fixed.RECORD_END, f"torn line\n{fixed.RECORD_END}")
    empty = f"LOG::Page::WillNavigateFrame :\n{fixed.RECORD_END}\n"
    events = read(spark, tmp_path, good + broken + empty)
    assert [r.malformed for r in events.orderBy("seq").collect()] == [False, True, True]
    assert {r.dst.value for r in chains.derive_edges(logs.event_columns(events)).collect()} == {"http://b/"}


def test_jump_tables_of_a_ring_are_few_and_not_broadcast(spark, capsys, monkeypatch):
    """A tail of five nodes into a ring of three: tables as far as the longest walk leads."""
    links = [(n, n + 1) for n in range(7)] + [(7, 5), (20, 21), (21, None)]
    made = []
    monkeypatch.setattr(jumps, "_further", lambda t, f=jumps._further: made.append(1) or f(t))
    got = jumps.walks(spark.createDataFrame([(0, 0), (1, 20), (2, 6)], "walk long, n long"),
                      spark.createDataFrame(links, "n long, to long"))
    got.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert len(made) <= 5
    along = {}
    for r in sorted(got.collect(), key=lambda r: r.pos):
        along.setdefault(r.walk, []).append(r.n)
    assert along == {0: [*range(8), 5], 1: [20, 21], 2: [6, 7, 5, 6]}


def test_walks_are_cut_by_node_numbers(spark, capsys):
    """No window of a walk holds the nodes themselves."""
    node = [fx.node(F.lit("f"), F.lit("URL"), F.col(c)).alias(n) for c, n in (("d", "dst"), ("s", "src"))]
    edges = spark.createDataFrame(
        [("l", f"http://{d}/", f"http://{s}/", "x", i) for i, (d, s) in enumerate(["cb", "ba", "ac"])],
        "log_id string, d string, s string, reason string, seq long").select(
        "log_id", *node, "reason", "seq", F.lit(chains.FIRST_WINS).alias("policy"))
    targets = spark.createDataFrame([("l", "http://c/")], "log_id string, ad_url string")
    found = chains.redirect_chains(chains.resolve_edges(edges), targets)
    found.explain()
    windows = [x for x in capsys.readouterr().out.splitlines() if "Window [" in x or "Window(" in x]
    assert windows and not any("src#" in x or "node#" in x.replace("_node#", "") for x in windows)
    chain, = found.collect()
    assert [h.node.value for h in chain.chain] == [f"http://{x}/" for x in "cbac"]
