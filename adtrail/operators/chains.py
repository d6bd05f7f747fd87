"""Redirect chains: causal edges from browser events, and the walk back from a landing page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adtrail import fixed, schemas
from adtrail.functions import fields as fx
from adtrail.functions.urls import complete_scheme
from adtrail.operators.records import field, first_frame_insert, nesting, pair_next, route_events
from adtrail.plans.components import roots
from adtrail.plans.cut import materialise
from adtrail.plans.groups import may_be_hot, number_rows, ordered
from adtrail.plans.jumps import walks
from adtrail.plans.stacks import unfit_ends

OVERWRITE, FIRST_WINS, LAST_RESORT = 0, 1, 2


# --- frames --------------------------------------------------------------------------------
def frame_roots(links: DataFrame) -> DataFrame:
    """``(log_id, frame, root)`` from ``(log_id, frame, parent, seq)``; the last parent counts."""
    last = links.groupBy("log_id", "frame").agg(F.max_by("parent", "seq").alias("parent"))
    return roots(last, ["log_id"], "frame", "parent")


def _opener_loads(events: DataFrame, **scan) -> DataFrame:
    """Frame loads with the window-open request that is still pending before them."""
    at = F.col("route")
    marked = events.where(at.isin("window_open", "load_frame"))
    opened = F.when(at == "window_open", F.struct(field("frame").alias("frame"), F.col("seq")))
    g = ordered(marked, ["log_id"], ["seq"], **scan).last(opened, "opener")
    return g.result().where((at == "load_frame") & F.col("opener").isNotNull()).select(
        "log_id", "seq", field("frame").alias("frame"), field("load_url").alias("load_url"),
        F.col("opener.frame").alias("opener"), F.col("opener.seq").alias("opened_at"))


def _links(events: DataFrame, loads: DataFrame) -> DataFrame:
    """Parent links: created child frames, and the first frame loaded after a window open."""
    children = events.where("route = 'child_frame'").select(
        "log_id", field("child_frame").alias("frame"), field("frame").alias("parent"), "seq")
    popups = loads.groupBy("log_id", "opened_at").agg(
        F.min_by(F.struct("frame", F.col("opener").alias("parent"), "seq"), "seq").alias("l"))
    return children.unionByName(popups.select("log_id", "l.*")).where(
        F.col("frame") != F.col("parent"))


# --- spans: what was running ---------------------------------------------------------------
def _call_name() -> Column:
    return F.trim(F.concat(F.coalesce(field("scriptID"), F.lit("")), F.lit(" "),
                           F.coalesce(field("callback_debug_name"), F.lit(""))))


def _timer_payload() -> tuple[Column, Column]:
    code = field("code")
    kind = F.when(code.isNotNull(), "code").otherwise("function")
    name = F.concat(F.trim(field("scriptID")), F.lit(" "), F.trim(field("callback_debug_name")))
    return kind, F.when(code.isNotNull(), F.trim(code)).otherwise(F.trim(name))


def span_marks(events: DataFrame, **scan) -> DataFrame:
    """Begin (+1) and End (-1) marks: ``(log_id, seq, frame, delta, kind, p1, p2)``."""
    route = F.col("route")
    events = events.withColumn("_frame", field("frame"))
    calls = pair_next(
        events, route == "handler_target", route.isin("handler_call", "handler_lazy"),
        F.struct(field("current_target").alias("target"), field("event").alias("event")),
        ["log_id", "_frame"], ["seq"], **scan)
    listener = F.concat(F.col("paired.target"), F.lit(":"), _call_name())
    begins = calls.select("log_id", "seq", F.col("_frame").alias("frame"), F.lit(1).alias("delta"),
                          F.lit("event_listener").alias("kind"), listener.alias("p1"),
                          F.col("paired.event").alias("p2"))
    t1, t2 = _timer_payload()
    plain = {
        "script_begin": (1, "compiled_script", field("scriptID"), field("url")),
        "script_end": (-1, "compiled_script", F.lit(None), F.lit(None)),
        "handler_end": (-1, "event_listener", field("current_target"), F.lit(None)),
        "timer_begin": (1, "scheduled_action", t1, t2),
        "timer_end": (-1, "scheduled_action", F.lit(None), t2),
        "animation_begin": (1, "request_animation_frame", field("callback_id"), F.lit(None)),
        "animation_end": (-1, "request_animation_frame", field("callback_id"), F.lit(None)),
    }

    def pick(i: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for name, spec in plain.items():
            value = spec[i] if isinstance(spec[i], Column) else F.lit(spec[i])
            out = F.when(route == name, value.cast(kind)).otherwise(out)
        return out

    others = events.where(route.isin(*plain)).select(
        "log_id", "seq", F.col("_frame").alias("frame"), pick(0, "int").alias("delta"),
        pick(1, "string").alias("kind"), pick(2, "string").alias("p1"),
        pick(3, "string").alias("p2"))
    return others.unionByName(begins)


def _fits(begin: Column, end: Column) -> Column:
    """An End fits a Begin of its kind with the same payload; any script End fits any script."""
    kind = end["kind"]
    return F.coalesce((begin["kind"] == kind) & F.when(
        kind == "scheduled_action", begin["p2"].eqNullSafe(end["p2"])).when(
        kind == "request_animation_frame", begin["p1"].eqNullSafe(end["p1"])).when(
        kind == "event_listener", F.coalesce(begin["p1"], F.lit("")).startswith(
            F.coalesce(end["p1"], F.lit("")))).otherwise(True), F.lit(False))


def _no_url(span: Column) -> Column:
    return (span["kind"] == "compiled_script") & (F.coalesce(span["p2"], F.lit("")) == "")


def valid_marks(marks: DataFrame, **scan) -> DataFrame:
    """Marks that count (``marks`` carries ``root``), with ``depth``: how many spans are open, the
    row's own included, leaving out scripts without URL.

    Ends that do not fit the innermost open span go. Well-nested families pass through prefix scans
    alone; only those in which some End meets a span that it does not fit are replayed, in chunks. A
    script without URL with nothing but such scripts below it does not run anything: it goes too,
    with its End.
    """
    span = F.struct("kind", "p1", "p2")
    keys = ["log_id", "root"]
    seen = nesting(marks, keys, ["seq"], "delta", span, **scan)
    odd = materialise(seen.where(F.col("closes") & ~_fits(F.col("open"), span)).select(*keys).distinct())
    if not odd.isEmpty():
        replay = marks.join(odd, keys, "left_semi")
        ignored = materialise(unfit_ends(replay, keys, "seq", ["kind", "p1", "p2"], _fits, **scan).select(
            "log_id", "seq"))
        marks = materialise(marks.join(ignored, ["log_id", "seq"], "left_anti"))
    nested = nesting(marks, keys, ["seq"], "delta", span, **scan)
    begins = F.col("delta") > 0
    bare = F.when(begins, _no_url(span)).otherwise(F.col("closes") & _no_url(F.col("open")))
    counted = F.when((begins | F.col("closes")) & ~F.col("_bare"), F.col("delta")).otherwise(0)
    deep = ordered(nested.withColumn("_bare", F.coalesce(bare, F.lit(False))), keys, ["seq"], **scan).running_sum(
        counted, "depth").result()
    return deep.where(~(F.col("_bare") & (F.col("depth") == 0))).select(*marks.columns, "depth")


def current_runner(queries: DataFrame, marks: DataFrame, roots_: DataFrame, **scan) -> DataFrame:
    """The innermost span open at each query: ``queries`` plus ``runner`` (NULL = none).

    ``queries``: ``(log_id, seq, frames array<string>)``, frames in order of preference. All
    relatives of a frame share its stack, so the runner is the latest unclosed span of the
    frame's family: a prefix scan per (log, root frame), not a range join.
    """
    asked = queries.select("log_id", "seq", F.posexplode("frames").alias("pos", "frame")).where(
        F.col("frame").isNotNull())
    rows = marks.select("log_id", "seq", "frame", "root", "delta", "kind", "p1", "p2",
                        F.lit(None).cast("int").alias("pos")).unionByName(
        _rooted(asked, roots_).select(
            "log_id", "seq", "frame", "root", F.lit(0).alias("delta"),
            F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("p1"),
            F.lit(None).cast("string").alias("p2"), "pos"))
    # a mark at the same record comes after the question about it
    rows = rows.withColumn("_tie", F.when(F.col("pos").isNull(), 1).otherwise(0))
    seen = nesting(rows, ["log_id", "root"], ["seq", "_tie", "pos"], "delta",
                   F.struct("frame", "kind", "p1", "p2"), **scan)
    o = F.col("open")
    runner = fx.runner_node(o["frame"], o["kind"], o["p1"], o["p2"])
    found = seen.where(F.col("pos").isNotNull() & o.isNotNull()).groupBy("log_id", "seq").agg(
        F.min_by(runner, "pos").alias("runner"))
    return queries.join(found, ["log_id", "seq"], "left")


def _rooted(df: DataFrame, roots_: DataFrame) -> DataFrame:
    return df.join(roots_, ["log_id", "frame"], "left").withColumn(
        "root", F.coalesce("root", "frame"))


# --- edges ---------------------------------------------------------------------------------
def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with two different, non-empty, non-blank ends."""
    dst, src = F.col("dst.value"), F.col("src.value")
    return edges.where((dst != "") & (src != "") & (dst != src)
                       & ~fx.is_blank_page(dst) & ~fx.is_blank_page(src))


def _edge(df: DataFrame, dst: Column, src: Column, reason, policy: int = FIRST_WINS) -> DataFrame:
    why = reason if isinstance(reason, Column) else F.lit(reason)
    return df.select("log_id", dst.alias("dst"), src.alias("src"), why.alias("reason"),
                     F.col("seq"), F.lit(policy).alias("policy"))


def _url(frame: Column, url: Column) -> Column:
    return fx.node(frame, F.lit("URL"), url)


def _page_based(df: DataFrame, key: Column, reason: str, policy: int = FIRST_WINS) -> DataFrame:
    """Edge from the frame's page, or its local root's page when the frame is blank.

    A last-resort edge stays in the loading frame either way.
    """
    own, top = field("frame_url"), field("local_frame_root_url")
    use_own = ~fx.is_blank_page(own)
    frame = F.when(use_own | F.lit(policy == LAST_RESORT), field("frame")).otherwise(
        field("local_frame_root"))
    page = F.when(use_own, own).otherwise(top)
    rows = df.where(use_own | ~fx.is_blank_page(top))
    return _edge(rows, _url(frame, key), _url(frame, page), reason, policy)


def derive_edges(events: DataFrame) -> DataFrame:
    """All causal edges of the events: ``(log_id, dst, src, reason, seq, policy)``.

    ``events``: ``(log_id, seq, header, fields, args, attrs)``. One projection per kind of event;
    what needs the running script goes through `current_runner`.
    """
    ev = materialise(route_events(events).where("route is not null").withColumn(
        "_frame", field("frame")))

    def rows(*routes: str) -> DataFrame:
        return ev.where(F.col("route").isin(*routes))

    # logs of ordinary length hold no group that must be split
    scan = {} if may_be_hot(ev, ["log_id"]) else {"hot": False}
    loads = materialise(_opener_loads(ev, **scan))
    roots_ = materialise(frame_roots(_links(ev, loads)))
    marks = materialise(valid_marks(materialise(_rooted(span_marks(ev, **scan), roots_)), **scan))

    # --- edges of plain fields
    plain = [
        _edge(rows("server_redirect"), _url(field("frame"), field("request_url")),
              _url(field("frame"), field("redirect_url")), "Server Redirect"),
        _page_based(rows("meta_refresh"), field("refresh_url"), "Meta Refresh"),
    ]
    r = F.col("route")
    history = pair_next(ev, r == "history_source", r == "history_target", field("frame_url"),
                        ["log_id", "_frame"], ["seq"], **scan)
    plain.append(_edge(history, _url(field("frame"), field("frame_url")),
                       _url(field("frame"), F.col("paired")), "History Push State"))
    bottom = marks.where("delta > 0 and depth = 1 and kind = 'compiled_script' and p2 <> ''")
    scripts = rows("script_begin").join(bottom.select("log_id", "seq"), ["log_id", "seq"],
                                        "left_semi")
    plain.append(_page_based(scripts, field("url"), "Script Load"))

    # --- edges that need the runner
    frame, main, origin = field("frame"), field("main_frame"), field("origin_frame")
    asks = (r.isin("js_navigation", "add_listener", "set_listener", "request_animation",
                   "set_timer", "script_insert", "set_attribute", "set_attribute_method"))
    alone = r.isin("request_animation", "script_insert")
    wanted = ev.where(asks).withColumn("frames", F.when(alone, F.array(frame)).when(
        r == "js_navigation", F.array(frame, main, origin)).otherwise(F.array(frame, main)))
    opener_asks = loads.select("log_id", "seq", F.array("opener").alias("frames"))
    answered = materialise(current_runner(
        wanted.select("log_id", "seq", "frames").unionByName(opener_asks), marks, roots_, **scan
    ).where("runner is not null").select("log_id", "seq", "runner"))
    run = ev.where(asks).join(answered, ["log_id", "seq"])
    by = F.col("runner")

    def ran(*routes: str) -> DataFrame:
        return run.where(F.col("route").isin(*routes))

    attr, value = field("attribute"), field("value")
    listener = field("listener", "args")
    event = fx.json_payload(field("type", "args"))
    target = F.concat(field("cpp_impl_ptr"), F.lit(":"), fx.function_payload(listener))
    hidden = fx.ignorable_url(field("frame_url")) & fx.ignorable_url(field("local_frame_root_url"))
    on_event = F.substring(attr, 3, 1 << 30)
    on_target = F.concat(field("cpp_impl_ptr"), F.lit(":"), _call_name())
    handler = field("handler", "args")
    timer_name = F.when(fx.is_json_payload(handler), "code").when(
        fx.is_function_payload(handler), "function")
    timer_code = F.coalesce(F.trim(fx.payload(handler, "json")), fx.payload(handler, "function"))
    set_url = _url(frame, fx.json_payload(value))
    is_set = ~F.coalesce(value.contains("V8 VALUE UNDEFINED"), F.lit(False))
    method_url = _url(frame, fx.json_payload(field("value", "args")))
    native = [
        _edge(ran("js_navigation"), _url(frame, field("url")), by, "JS Navigation"),
        _edge(ran("add_listener").where(fx.is_function_payload(listener) & ~hidden),
              fx.node(frame, F.lit("event_listener"), target, event), by,
              F.concat(event, F.lit("_listener")), OVERWRITE),
        _edge(ran("set_listener"), fx.node(frame, F.lit("event_listener"), on_target, on_event),
              by, F.concat(F.lit("on_"), on_event, F.lit("_listener"))),
        _edge(ran("request_animation"),
              fx.node(frame, F.lit("request_animation_frame"), field("callback_id")), by,
              "animation_callback"),
        _edge(ran("set_timer").where(timer_name.isNotNull()),
              fx.node(frame, F.lit("scheduled_action"), timer_name, timer_code), by,
              "scheduled_action"),
        _edge(ran("script_insert").where(field("src_url").isNotNull()),
              _url(frame, complete_scheme(field("src_url"), field("frame_url"))), by,
              "Dynamic Script Load"),
        _edge(ran("set_attribute").where(
            is_set & (attr == "src") & (field("interface") == "HTMLScriptElement")),
            set_url, by, "Dynamic Script Load - set att"),
        _edge(ran("set_attribute").where(
            is_set & (attr == "href") & (field("interface") == "HTMLAnchorElement")
            & ~set_url.eqNullSafe(by)), set_url, by, "Anchor link setup - set att"),
        _edge(ran("set_attribute_method").where(
            (field("name", "args") == '::JSON::"href"::JSON::') & ~method_url.eqNullSafe(by)),
            method_url, by, "Anchor link setup - set att method"),
    ]
    lazy = marks.where("delta > 0 and kind = 'event_listener'").join(
        rows("handler_lazy").select("log_id", "seq", field("frame_url").alias("page")),
        ["log_id", "seq"])
    dom0 = _edge(lazy, fx.node(F.col("frame"), F.lit("event_listener"), F.col("p1"), F.col("p2")),
                 _url(F.col("frame"), F.col("page")),
                 F.concat(F.lit("dom0_"), F.col("p2"), F.lit("_listener")), OVERWRITE)

    base = valid_edges(_union(plain)).unionByName(_union(native)).unionByName(dom0)
    base = materialise(base)
    return base.unionByName(_load_edges(ev, rows("load_frame"), loads, answered, base, scan))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _is_page(node: Column) -> Column:
    return (node["kind"] == "URL") & ~fx.is_blank_page(node["value"])


def upstream_url(asked: DataFrame, edges: DataFrame, url: str = "load_url", **scan) -> DataFrame:
    """Why a URL was loaded elsewhere: of the nodes for it, in any frame, the first made whose edge,
    at the moment of the question, does not come from a real page.

    ``asked``: ``(log_id, seq, <url>)``, no seq twice in a log. Adds ``up struct<src, reason>``. An
    edge counts from the next record on; a node keeps its first edge until one overwrites it.
    """
    node = ["log_id", "dst"]
    into = edges.where((F.col("dst.kind") == "URL") & (F.col("policy") != LAST_RESORT))
    first = into.groupBy(*node).agg(F.min("seq").alias("born"))
    plain = into.where(F.col("policy") == FIRST_WINS).groupBy(*node).agg(
        F.min_by(F.struct("src", "reason", "seq"), "seq").alias("e")).select(*node, "e.*")
    held = into.where(F.col("policy") == OVERWRITE).select(*node, "src", "reason", "seq").withColumn(
        "over", F.lit(True)).unionByName(plain.withColumn("over", F.lit(False)))
    # an ordinary edge after the first one changes nothing
    changes = held.join(first, node).where("over or seq = born")
    spans = ordered(changes, node, ["seq"], **scan).next(F.col("seq"), "until").result()
    spans = spans.where(~_is_page(F.col("src"))).select(
        "log_id", F.col("dst.value").alias(url), F.struct("born", "dst", "src", "reason").alias("up"),
        F.col("seq").alias("since"), "until")
    spans = materialise(spans)
    # edges that stay: the smallest of those made before the question, by a prefix scan
    lasting = spans.where("until is null").select("log_id", url, F.col("since").alias("seq"), "up")
    rows = lasting.withColumn("_tie", F.lit(1)).unionByName(
        asked.select("log_id", url, "seq").withColumn("_tie", F.lit(0)), allowMissingColumns=True)
    stayed = ordered(rows, ["log_id", url], ["seq", "_tie", "up"], **scan).running_min(
        F.col("up"), "found", before=True).result().where("_tie = 0 and found is not null").select(
        "log_id", "seq", F.col("found").alias("up"))
    # edges that are overwritten later: few, and each holds for a while
    passing = spans.where("until is not null").join(asked.select("log_id", url, "seq"), ["log_id", url]).where(
        "since < seq and seq <= until").select("log_id", "seq", "up")
    hits = stayed.unionByName(passing).groupBy("log_id", "seq").agg(F.min("up").alias("up")).select(
        "log_id", "seq", F.struct("up.src", "up.reason").alias("up"))
    return asked.join(hits, ["log_id", "seq"], "left")


def _fingerprint(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def _load_edges(ev, load_rows, loads, answered, base, scan) -> DataFrame:
    """Edges of frame loads: link click, window open, unknown insert, frame load, last resort.

    What explains a load depends on the edges made before it, those of other loads included. So the
    loads are judged against each other's edges again and again until nothing changes; each round
    settles at least the next load of every chain of dependent loads.
    """
    # the first load of a frame that was announced by an inserted HTML node
    announced = first_frame_insert(ev).withColumnRenamed("seq", "inserted_at")
    first_load = load_rows.select("log_id", F.col("_frame").alias("frame"), "seq",
                                  field("load_url").alias("load_url")).join(
        announced, ["log_id", "frame"]).where(F.col("seq") > F.col("inserted_at"))
    firsts = materialise(first_load.groupBy("log_id", "frame").agg(
        F.min_by(F.struct("seq", "load_url"), "seq").alias("f")).select("log_id", "frame", "f.*"))
    judged = materialise(loads.join(answered, ["log_id", "seq"], "left"))
    dst = _url(F.col("frame"), F.col("load_url"))

    def framed(rest: DataFrame) -> DataFrame:
        return valid_edges(_page_based(rest, field("load_url"), "Frame Load"))

    made, used = materialise(framed(load_rows)), judged.select("log_id", "seq").limit(0)
    if not (judged.isEmpty() and firsts.isEmpty()):
        known = _fingerprint(made)
        while True:
            made, used = _explained(load_rows, judged, firsts, dst, base, made, framed, scan)
            before, known = known, _fingerprint(made)
            if before == known:
                break
    rest = load_rows.join(used, ["log_id", "seq"], "left_anti")
    return made.unionByName(_page_based(rest, field("load_url"), "Load Frame", LAST_RESORT))


def _explained(load_rows, judged, firsts, dst, base, made, framed, scan) -> tuple[DataFrame, DataFrame]:
    """The edges of all loads, given those found so far, and the loads that use up a window open."""
    edges = base.unionByName(made)
    into = edges.where("dst.kind = 'URL'").groupBy(
        "log_id", F.col("dst.frame_id").alias("opener"), F.col("dst.value").alias("load_url")
    ).agg(F.min("seq").alias("linked_at"))
    clicked = F.coalesce((F.col("linked_at") < F.col("seq")) & (F.col("opener") != F.col("frame")), F.lit(False))
    explained = judged.join(into, ["log_id", "opener", "load_url"], "left").withColumn("clicked", clicked).where(
        "clicked or runner is not null")
    # an open request is used up by the first load that a link or a runner explains
    used = materialise(explained.groupBy("log_id", "opened_at").agg(F.min_by(
        F.struct("seq", "frame", "load_url", "opener", "runner", "clicked"), "seq").alias("u")).select("log_id", "u.*"))
    clicks = _edge(used.where("clicked"), dst, _url(F.col("opener"), F.col("load_url")),
                   "Anchor link click", OVERWRITE)
    opens = _edge(used.where("not clicked"), dst, F.col("runner"), "Window Open", OVERWRITE)
    unused = [df.join(used.select("log_id", "seq"), ["log_id", "seq"], "left_anti") for df in (firsts, load_rows)]
    unknown = upstream_url(unused[0], edges, **scan).where("up is not null")
    guessed = _edge(unknown, dst, F.col("up.src"), F.concat(F.col("up.reason"), F.lit(" unknown")), OVERWRITE)
    return materialise(_union([clicks, opens, guessed, framed(unused[1])])), used.select("log_id", "seq")


def load_urls(events: DataFrame) -> DataFrame:
    """The page that a session started from, ``(log_id, load_url)``: the first frame load of an
    ``http`` URL. ``events`` as in `derive_edges`."""
    loads = route_events(events).where("route = 'load_frame'").withColumn("load_url", field("load_url"))
    return loads.where(F.col("load_url").startswith("http")).groupBy("log_id").agg(
        F.min_by("load_url", "seq").alias("load_url"))


def resolve_edges(edges: DataFrame) -> DataFrame:
    """One edge per node: the last overwriting one, else the first ordinary one, else the last
    of the last-resort ones. One aggregation, pre-combined before the shuffle."""
    row = F.struct("src", "reason", "seq")

    def when(policy: int) -> Column:
        return F.when(F.col("policy") == policy, F.col("seq"))

    best = edges.groupBy("log_id", "dst").agg(
        F.max_by(row, when(OVERWRITE)).alias("o"), F.min_by(row, when(FIRST_WINS)).alias("f"),
        F.max_by(row, when(LAST_RESORT)).alias("l"),
        F.min("seq").alias("born"))
    return best.withColumn("e", F.coalesce("o", "f", "l")).select(
        "log_id", "dst", "e.src", "e.reason", "e.seq", "born")


# --- the walk ------------------------------------------------------------------------------
def lookup_edge(edges: DataFrame) -> DataFrame:
    """Link each resolved edge to the one that explains its source: adds ``eid`` and ``next``.

    A listener node without an edge of its own frame falls back to the earliest edge for the
    same listener in any frame.
    """
    numbered = number_rows(edges, ["log_id", "born", "dst"], "eid")
    key = [F.col(f"dst.{c}") for c in ("frame_id", "kind", "value")]
    exact = numbered.select("log_id", F.col("dst").alias("src"), F.col("eid").alias("_exact"))
    loose = numbered.where(key[1] == "event_listener").groupBy(
        "log_id", key[1].alias("_k"), key[2].alias("_v"), F.col("dst.value2").alias("_v2")).agg(
        F.min("eid").alias("_loose"))
    out = numbered.withColumns({"_sf": F.col("src.frame_id"), "_k": F.col("src.kind"),
                                "_v": F.col("src.value"),
                                "_v2": F.col("src.value2")})
    e = exact.select("log_id", F.col("src.frame_id").alias("_sf"), F.col("src.kind").alias("_k"),
                     F.col("src.value").alias("_v"),
                     F.coalesce("src.value2", F.lit("")).alias("_v2x"), "_exact")
    out = out.withColumn("_v2x", F.coalesce("_v2", F.lit("")))
    joined = out.join(e.hint("merge"), ["log_id", "_sf", "_k", "_v", "_v2x"], "left").join(
        loose, ["log_id", "_k", "_v", "_v2"], "left")
    return joined.withColumn("next", F.coalesce("_exact", "_loose")).select(
        *edges.columns, "eid", "next")


def redirect_chains(edges: DataFrame, targets: DataFrame, limit: int | None = fixed.CHAIN_LIMIT,
                    last_reason: str = "FIRST") -> DataFrame:
    """Chains from landing URLs back to their origin: ``(log_id, ad_url, chain)``.

    ``edges``: resolved edges. ``targets``: ``(log_id, ad_url[, load_url])``. A chain ends where
    no edge leads on, at the session's load URL, when a (node, reason) repeats, or after
    ``limit`` edges; its last entry is the node reached. A URL without an edge has no chain.

    The edges of all walks are listed by jump tables over the edge numbers and then cut where the
    first of these ends comes.
    """
    if "load_url" not in targets.columns:
        targets = targets.withColumn("load_url", F.lit(None).cast("string"))
    linked = materialise(lookup_edge(edges))
    first = linked.where("dst.kind = 'URL'").groupBy(
        "log_id", F.col("dst.value").alias("ad_url")).agg(
        F.min_by(F.struct("eid", "dst"), "eid").alias("s"))
    starts = materialise(targets.select("log_id", "ad_url", "load_url").distinct().join(
        first, ["log_id", "ad_url"]).select(
        "log_id", "ad_url", "load_url", F.col("s.eid").alias("n"), F.col("s.dst").alias("start")).withColumn(
        "walk", F.monotonically_increasing_id()))
    listed = walks(starts, linked.select(F.col("eid").alias("n"), F.col("next").alias("to")), limit)
    # files of edges and walks are far smaller than their rows, so none of them is broadcast;
    # walks are cut by the numbers of their nodes; the nodes themselves follow only for what is kept
    numbers = materialise(linked.groupBy("log_id", "src").agg(F.min("eid").alias("_to")))
    ends = linked.join(numbers, ["log_id", "src"]).select(
        F.col("eid").alias("n"), "_to", F.when(F.col("src.kind") == "URL", F.col("src.value")).alias("_url"))
    begun = starts.join(numbers.select("log_id", F.col("src").alias("start"), F.col("_to").alias("_start")),
                        ["log_id", "start"], "left").select("walk", "load_url", F.coalesce("_start", F.lit(-1)).alias("_start"))
    home = F.coalesce(F.col("_url").eqNullSafe(F.col("load_url")) & F.col("_url").isNotNull(), F.lit(False))
    hops = listed.join(ends.hint("merge"), "n").join(begun.hint("merge"), "walk").select("walk", "n", "pos", "_to", "_start", home.alias("_home"))
    along = Window.partitionBy("walk").orderBy("pos")
    hops = hops.withColumn("_node", F.coalesce(F.lag("_to").over(along), F.col("_start")))
    # one edge leads on from a node, so a node that returns does so with its reason
    again = F.row_number().over(Window.partitionBy("walk", "_node").orderBy("pos")) > 1
    whole = Window.partitionBy("walk")
    hops = hops.withColumn("_again", again).withColumn(
        "_end", F.least(F.min(F.when(F.col("_again"), F.col("pos"))).over(whole),
                        F.min(F.when(F.col("_home"), F.col("pos") + 1)).over(whole)))
    kept = hops.where(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).select("walk", "n", "pos")
    chains = kept.join(linked.select(F.col("eid").alias("n"), "src", "reason").hint("merge"), "n").groupBy("walk").agg(
        F.sort_array(F.collect_list(F.struct("pos", "src", "reason"))).alias("h"))
    # the node of a hop is the source of the one before
    node = F.concat(F.array("start"), F.transform("h", lambda x: x["src"]))
    reason = F.concat(F.transform("h", lambda x: x["reason"]), F.array(F.lit(last_reason)))
    chain = F.zip_with(node, reason, lambda x, why: F.struct(x.alias("node"), why.alias("reason")))
    return chains.join(starts.hint("merge"), "walk").select("log_id", "ad_url", chain.alias("chain"))


def chain_rows(chains: DataFrame) -> DataFrame:
    """One row per hop: ``(log_id, ad_url, hop, node, reason)``."""
    return chains.select("log_id", "ad_url", F.posexplode("chain").alias("hop", "h")).select(
        "log_id", "ad_url", "hop", "h.node", "h.reason")


def as_redirections(chain: str = "chain") -> Column:
    """The chain in the form that ads carry it."""
    return F.transform(chain, lambda h: F.struct(
        h["node"]["frame_id"].alias("frame_id"), h["node"]["kind"].alias("kind"),
        h["node"]["value"].alias("value"), h["node"]["value2"].alias("value2"),
        h["reason"].alias("reason")))


def url_chains(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Chains over URL-only edges ``(log_id, dst_url, src_url, reason, seq)``: the older form,
    without frames, without a length limit, the first edge into a URL counting."""
    rows = edges.select(
        "log_id", _url(F.lit(""), F.col("dst_url")).alias("dst"),
        _url(F.lit(""), F.col("src_url")).alias("src"), "reason", "seq",
        F.lit(FIRST_WINS).alias("policy"))
    return redirect_chains(resolve_edges(valid_edges(rows)), targets, limit=None, last_reason="")


def sessions_with_ads(ads: DataFrame) -> DataFrame:
    """Sessions with at least one non-empty chain, and how many such ads they hold."""
    return ads.where(F.size("redirections") > 0).groupBy("log_id").agg(
        F.count(F.lit(1)).alias("ads"))
