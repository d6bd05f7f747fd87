"""Column functions over log fields, verdicts, responses and page elements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adtrail import fixed
from adtrail.functions.cols import Col, as_col


def _unquoted(u: Column) -> Column:
    return F.regexp_replace(u, '^"+|"+$', "")


def is_blank_page(u: Col) -> Column:
    return _unquoted(as_col(u)) == "about:blank"


def ignorable_url(u: Col) -> Column:
    """Empty, an extension page, or a blank page."""
    c = as_col(u)
    return (c.isNull() | (c == "") | c.startswith("chrome-extension")
            | c.startswith("about:blank") | c.startswith('"about:blank"'))


def verdict_flags(result: Col) -> Column:
    """``struct<flag, se_flag, text>`` of a lookup answer; the text ``None`` means clean."""
    r = as_col(result)
    flag = r != "None"
    return F.struct(
        flag.alias("flag"),
        (flag & r.contains(fixed.THREAT_WORD)).alias("se_flag"),
        F.when(flag, r).otherwise("").alias("text"),
    )


def report_fields(json: Col) -> Column:
    """``struct<positives, total>``: NULLs without an answer, -1 when the file is unknown."""
    j = as_col(json)
    body = F.from_json(j, "struct<response_code:int,positives:int,total:int>")

    def field(name: str) -> Column:
        return (F.when(j.isNull() | (j == ""), F.lit(None).cast("int"))
                .when(body["response_code"] != 1, -1).otherwise(body[name]))

    return F.struct(field("positives").alias("positives"), field("total").alias("total"))


def _redirect_target(status, headers, final_url, body):
    return F.when(status == 302, F.try_element_at(headers, F.lit("location")))


def _refresh_target(status, headers, final_url, body):
    start, stop = F.instr(body, "url="), F.instr(body, '"</html>')
    return F.when((status == 200) & (start > 0) & (stop > 0),
                  F.substring(body, start + 4, F.greatest(stop - start - 4, F.lit(0))))


def _final_url(status, headers, final_url, body):
    return F.when(status == 200, final_url)


NEXT_HOP = {
    "redirect": _redirect_target,
    "meta_refresh": _refresh_target,
    "multiple_nojs_redirects": _final_url,
}


def next_hop(kind: Col, status: Col, headers: Col, final_url: Col, body: Col,
             registry: dict | None = None) -> Column:
    """Where a polled page leads, by the parser its feeder names; NULL if it does not fit.

    ``registry`` maps a parser name to a function of (status, headers, final_url, body) columns;
    callers add their own entries. Header names are expected in lower case.
    """
    args = tuple(as_col(c) for c in (status, headers, final_url, body))
    out = F.lit(None).cast("string")
    for name, rule in (registry or NEXT_HOP).items():
        out = F.when(as_col(kind) == name, rule(*args)).otherwise(out)
    return out


def ipv4_answers(answer: Col) -> Column:
    """The address-shaped lines of a name-lookup answer, as an array."""
    lines = F.split(F.trim(as_col(answer)), "\n")
    return F.filter(lines, lambda x: x.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"))


def parse_rank(rank: Col) -> Column:
    r = F.trim(as_col(rank))
    return F.when(r == fixed.UNRANKED, fixed.UNRANKED_VALUE).otherwise(r.try_cast("int"))


def round_down(x: Col, base: int) -> Column:
    return F.floor(as_col(x) / base) * base


def json_payload(value: Col) -> Column:
    """``::JSON::"text"::JSON::`` without its nine-character ends."""
    v = as_col(value)
    return F.substring(v, F.lit(10), F.greatest(F.length(v) - 18, F.lit(0)))


def function_payload(value: Col) -> Column:
    """``<=V8 FUNCTION=> scriptID=21 (4,17) name`` as ``21 (4,17) name``."""
    return F.trim(F.regexp_extract(as_col(value), r"(?s)^<=V8 FUNCTION=>[^=]*=(.*)$", 1))


def is_json_payload(value: Col) -> Column:
    return as_col(value).startswith("::JSON::")


def is_function_payload(value: Col) -> Column:
    return as_col(value).startswith("<=V8 FUNCTION=>")


def is_missing_payload(value: Col) -> Column:
    v = as_col(value)
    return v.startswith("<=V8 VALUE NULL=>") | v.startswith("<=V8 VALUE UNDEFINED=>")


def payload(value: Col, form: str) -> Column:
    """Normalised payload text: ``form`` is ``json`` or ``function``; NULL if it is neither."""
    if form == "json":
        return F.when(is_json_payload(value), json_payload(value))
    if form == "function":
        return F.when(is_function_payload(value), function_payload(value))
    raise ValueError(form)


def last_token(line: Col) -> Column:
    """Text after the last space of a line."""
    return F.regexp_extract(as_col(line), r"(\S+)\s*$", 1)


def node(frame: Col, kind: Col, value: Col, value2: Col | None = None) -> Column:
    """A chain node: ``struct<frame_id, kind, value, value2>``."""
    second = F.lit(None).cast("string") if value2 is None else as_col(value2)
    return F.struct(as_col(frame).alias("frame_id"), as_col(kind).alias("kind"),
                    as_col(value).alias("value"), second.alias("value2"))


def runner_node(frame: Col, kind: Col, payload1: Col, payload2: Col) -> Column:
    """Chain node of an open span: scripts become URL nodes, others keep their kind."""
    k = as_col(kind)
    is_script = k == "compiled_script"
    return node(frame, F.when(is_script, "URL").otherwise(k),
                F.when(is_script, as_col(payload2)).otherwise(as_col(payload1)),
                F.when(is_script, F.lit(None).cast("string")).otherwise(as_col(payload2)))


def session_id(machine: Col, box: Col, ts: Col) -> Column:
    return F.concat_ws("_", as_col(machine), as_col(box),
                       F.unix_micros(as_col(ts)).cast("string"))


def element_area(height: Col, width: Col) -> Column:
    return as_col(height) * as_col(width)


def in_viewport(mid_x, mid_y, height, width, view_height, view_width) -> Column:
    x, y, h, w = (as_col(c) for c in (mid_x, mid_y, height, width))
    return ((h != 0) & (w != 0) & (y > 0) & (x > 0)
            & (y < as_col(view_height)) & (x < as_col(view_width)))
