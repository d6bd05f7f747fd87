"""Operators over browser event records and session log lines."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adtrail import fixed
from adtrail.functions.fields import last_token
from adtrail.plans.cut import materialise
from adtrail.plans.groups import first_per, ordered
from adtrail.plans.jumps import walks

# Header text -> kind of event, in the order in which the tests must be made.
_ROUTES = [
    ("::DidReceiveMainResourceRedirect", "server_redirect"),
    ("::DidHandleHttpRefresh", "meta_refresh"),
    ("::WillNavigateFrame", "js_navigation"),
    ("::WindowOpen", "window_open"),
    ("::WillLoadFrame", "load_frame"),
    ("::DidCompileScript", "script_begin"),
    ("::DidRunCompiledScriptEnd", "script_end"),
    ("::DidCallHandleEventBegin", "handler_target"),
    ("::DidCallFunctionBegin", "handler_call"),
    ("::DidCompileLazyEventListener", "handler_lazy"),
    ("::DidCallHandleEventEnd", "handler_end"),
    ("::DidFireScheduledActionBegin", "timer_begin"),
    ("::DidFireScheduledActionEnd", "timer_end"),
    ("::ExecuteFrameRequestCallbackBegin", "animation_begin"),
    ("::ExecuteFrameRequestCallbackEnd", "animation_end"),
    ("::DidCallV8MethodCallback", "method_callback"),
    ("::DidCallV8MethodTemplate", "method"),
    ("::RequestAnimationFrame", "request_animation"),
    ("::DidCallV8SetAttributeEventListener", "set_listener"),
    ("::DidInsertDOMNode", "insert"),
    ("::DidCallV8SetAttribute", "set_attribute"),
    ("::DidCreateChildFrame", "child_frame"),
]


def field(name: str, of: str = "fields") -> Column:
    return F.try_element_at(F.col(of), F.lit(name))


def route_events(events: DataFrame) -> DataFrame:
    """Add ``route``, the kind of each event; events of no interest get NULL."""
    by_header = None
    for text, route in _ROUTES:
        hit = F.col("header").contains(text)
        by_header = F.when(hit, route) if by_header is None else by_header.when(hit, route)
    face, attr = field("interface"), field("attribute")
    history = (face == "History") & attr.isin("pushState", "replaceState")
    named = events.withColumn("_r", by_header)
    r = F.col("_r")
    return named.withColumn(
        "route",
        F.when((r == "method_callback") & history, "history_source")
        .when((r == "method") & history, "history_target")
        .when((r == "method") & (face == "EventTarget") & (attr == "addEventListener"),
              "add_listener")
        .when((r == "method") & (face == "Window") & attr.isin("setTimeout", "setInterval"),
              "set_timer")
        .when((r == "method") & (face == "Element") & (attr == "setAttribute"),
              "set_attribute_method")
        .when((r == "insert") & (field("node") == "SCRIPT"), "script_insert")
        .when((r == "insert") & (field("node") == "HTML"), "html_insert")
        .when(r.isin("method_callback", "method", "insert"), None)
        .otherwise(r)).drop("_r")


def downloads(events: DataFrame) -> DataFrame:
    """Download-start records; ``urls`` is the redirect chain of the download.

    Reads ``lines array<struct<key,value>>`` where present, since the ``url`` key repeats.
    """
    rows = events.where(F.col("header").contains("::DownloadManagerImpl::"))
    plain = ["guid", "start_time", "remote_address", "mime_type", "original_mime_type",
             "http_req_method", "referrer_url", "site_url", "tab_url", "tab_referrer_url",
             "total_bytes", "has_user_gesture", "transient", "file_path"]
    chain = F.transform(F.filter("lines", lambda x: x["key"] == "url"), lambda x: x["value"])
    return rows.select(
        "log_id", "seq", *[field(p).alias(p) for p in plain], chain.alias("urls")
    ).withColumn("total_bytes", F.col("total_bytes").try_cast("bigint")).withColumn(
        "has_user_gesture", F.col("has_user_gesture").isin("1", "true"))


def bridge_calls(events: DataFrame) -> DataFrame:
    """Script-to-Java bridge records; ``args`` is the JSON text of the call."""
    rows = events.where(F.col("header").contains("::GinJavaBridgeDispatcherHost::"))
    args = F.regexp_replace(field("method_args"), "^::JSON::|::JSON::$", "")
    return rows.select(
        "log_id", "seq", F.regexp_extract("header", r"::(\w+)\s*:\s*$", 1).alias("call"),
        field("routing_id").try_cast("int").alias("routing_id"),
        field("object_id").try_cast("int").alias("object_id"),
        field("name").alias("name"), field("method_name").alias("method_name"),
        args.alias("method_args"))


def tagged_lines(lines: DataFrame, tag: str = fixed.ALERT_TAG, line: str = "line") -> DataFrame:
    return lines.where(F.col(line).contains(tag))


def drop_adjacent_duplicates(events: DataFrame, compare: Sequence[str],
                             keys: Sequence[str] = ("log_id",),
                             order_by: Sequence[str] = ("seq",), **scan) -> DataFrame:
    """Drop a record whose ``compare`` columns equal those of the record just before it."""
    g = ordered(events, keys, order_by, **scan).previous_row(
        F.struct(*[F.col(c) for c in compare]), "_prev")
    same = None
    for c in compare:
        term = F.col(f"_prev.v.{c}").eqNullSafe(F.col(c))
        same = term if same is None else same & term
    return g.result().where(F.col("_prev").isNull() | ~same).drop("_prev")


def record_body(events: DataFrame, ignore: Sequence[str] = ("timestamp",),
                compare_header: bool = True) -> DataFrame:
    """Add ``body``: the record as comparable text, without the ignored fields."""
    def text(col: str) -> Column:
        entries = F.map_entries(F.map_filter(col, lambda k, v: ~k.isin(*ignore)))
        return F.to_json(F.array_sort(entries))
    parts = [text("fields"), text("args"), text("attrs")]
    if compare_header:
        parts.insert(0, F.col("header"))
    return events.withColumn("body", F.to_json(F.struct(*[
        p.alias(f"p{i}") for i, p in enumerate(parts)])))


def _read_pages(pages: DataFrame, gap: int) -> DataFrame:
    """Page-URL lines ``(log_id, line_no)`` that are read as such: reading one takes the ``gap`` lines
    below it along, and a page-URL line among these does not count.

    Only lines within ``gap`` of each other matter to one another. The first of such a run counts, and
    each one that counts leads to the first beyond its own lines, which is at most ``2 * gap`` below.
    """
    place = F.struct("log_id", "line_no")

    def below(first: int, last: int) -> DataFrame:
        near = pages.select("log_id", F.col("line_no").alias("_from"), F.explode(F.array(*[
            F.col("line_no") + i for i in range(first, last + 1)])).alias("line_no"))
        return near.join(pages, ["log_id", "line_no"])

    follows = below(1, gap).select("log_id", "line_no").distinct()
    starts = pages.join(follows, ["log_id", "line_no"], "left_anti").select(place.alias("walk"), place.alias("n"))
    nexts = below(gap + 1, 2 * gap).groupBy("log_id", F.col("_from").alias("line_no")).agg(
        F.min("line_no").alias("_next"))
    beyond = F.when(F.col("_next").isNotNull(), F.struct("log_id", F.col("_next").alias("line_no")))
    links = pages.join(nexts, ["log_id", "line_no"], "left").select(place.alias("n"), beyond.alias("to"))
    return walks(starts, links).select("n.*")


def session_ads(lines: DataFrame, gap: int = 2, **scan) -> DataFrame:
    """Landing pages named in session logs: ``(log_id, line_no, ad_url, screenshot, event_log,
    home_url)``.

    A page-URL line is read together with the ``gap`` lines below it (2 in the current dialect, 1 in
    the older one), which count for nothing else; it names an ad if the last of them names a
    screenshot. The browser log is the latest one named above the line, the home URL the first one
    of the session, if it comes before.
    """
    line = F.col("line")
    marks = {"page": line.contains(fixed.PAGE_URL_MARKER), "shot": line.contains(fixed.SCREENSHOT_MARKER),
             "log": line.contains(fixed.EVENT_LOG_MARKER)}
    marked = materialise(lines.select("log_id", "line_no", last_token(line).alias("token"), line.contains("URL").alias(
        "url"), *[m.alias(n) for n, m in marks.items()]).where("page or shot or log"))
    read = materialise(_read_pages(marked.where("page").select("log_id", "line_no"), gap))
    # line numbers are dense, so the lines below are equi-joins on (session, number)
    taken = read.select("log_id", F.explode(F.array(*[F.col("line_no") + i for i in range(1, gap + 1)])).alias("line_no"))
    free = marked.join(taken, ["log_id", "line_no"], "left_anti")
    home = free.where("shot and url").groupBy("log_id").agg(
        F.min(F.struct("line_no", F.col("token").alias("url"))).alias("_home"))
    shots = marked.where("shot").select(
        "log_id", (F.col("line_no") - gap).alias("line_no"), F.col("token").alias("_path"))
    g = ordered(free.where("page or log"), ["log_id"], ["line_no"], **scan).last(
        F.when(F.col("log"), F.col("token")), "event_log")
    pages = g.result().where("page").join(shots, ["log_id", "line_no"])
    return pages.join(home, "log_id", "left").select(
        "log_id", "line_no", F.col("token").alias("ad_url"),
        F.regexp_extract("_path", r"([^/]*)$", 1).alias("screenshot"),
        F.col("_path").alias("screenshot_path"), "event_log",
        # a line that names both is home first
        F.when(F.col("_home.line_no") <= F.col("line_no"), F.col("_home.url")).alias("home_url"))


def session_outcome(lines: DataFrame) -> DataFrame:
    """Last home screenshot, last home URL and whether anything was downloaded, per session."""
    line = F.col("line")
    return lines.groupBy("log_id").agg(
        F.max_by(last_token(line), F.when(line.contains(fixed.HOME_SCREENSHOT_MARKER),
                                          F.col("line_no"))).alias("screenshot_path"),
        F.max_by(last_token(line), F.when(line.contains(fixed.HOME_URL_MARKER),
                                          F.col("line_no"))).alias("loaded_url"),
        F.max(line.contains(fixed.DOWNLOAD_MARKER)).alias("downloaded_files"))


def nesting(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], delta: str,
            payload: Column, **scan) -> DataFrame:
    """Begin/End nesting as two prefix scans instead of a stack.

    ``delta`` is +1 on a Begin, -1 on an End and 0 elsewhere. Adds ``level`` (of the call that
    the row begins, ends, or lies in; 0 = outside), ``closes`` (an End that has a Begin) and
    ``open``: ``payload`` of the innermost call the row belongs to. An End without an open Begin
    is ignored, as if the depth were cut off at zero.
    """
    g = ordered(df, keys, order_by, **scan)
    g = g.running_sum(F.col(delta), "_sum").running_min(F.col("_sum"), "_min", before=True)
    floor = F.least(F.lit(0), F.coalesce("_min", F.lit(0)))
    depth = F.col("_sum") - F.least(floor, F.col("_sum"))
    closes = (F.col(delta) < 0) & (F.col("_sum") >= floor)
    g = g.with_columns({
        "closes": closes,
        "level": F.when(closes, depth + 1).otherwise(depth).cast("int")})
    begin = F.when(F.col(delta) > 0, payload)
    return g.last(begin, "open", within=["level"]).result().drop("_sum", "_min")


def enclosing_calls(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], delta: str,
                    **scan) -> DataFrame:
    """Add ``call``: where the innermost call around each row began (NULL outside)."""
    at = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    return nesting(df, keys, order_by, delta, at, **scan).withColumnRenamed("open", "call")


def pair_next(df: DataFrame, begin: Column, end: Column, value: Column, keys: Sequence[str],
              order_by: Sequence[str], **scan) -> DataFrame:
    """End rows joined with the latest unused Begin of their group: adds ``paired``.

    Every End uses up what is pending, so an End without a Begin since the last End is dropped.
    """
    marked = df.withColumns({"_b": begin, "_e": end}).where("_b or _e")
    at = F.struct(*order_by)
    g = ordered(marked, keys, order_by, **scan)
    g = g.last(F.when(F.col("_b"), F.struct(at.alias("at"), value.alias("v"))), "_begin",
               before=True)
    g = g.last(F.when(F.col("_e"), at), "_used", before=True)
    fresh = F.col("_begin").isNotNull() & (
        F.col("_used").isNull() | (F.col("_used") < F.col("_begin.at")))
    return g.result().where(F.col("_e") & fresh).withColumn(
        "paired", F.col("_begin.v")).drop("_b", "_e", "_begin", "_used")


def first_frame_insert(events: DataFrame) -> DataFrame:
    """First HTML node insert of each frame: ``(log_id, frame, seq)``."""
    return events.where("route = 'html_insert'").groupBy(
        "log_id", field("frame").alias("frame")).agg(F.min("seq").alias("seq"))
