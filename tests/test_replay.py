"""Edges against a replay of random logs, record by record."""

import random

import pytest

from adtrail.operators import chains
from adtrail.plans.stacks import unfit_ends

URLS = [f"http://{c}/" for c in "pqrst"]
BLANK = "about:blank"
JSON = '::JSON::"{}"::JSON::'.format
FUNCTION = "<=V8 FUNCTION=> scriptID={}".format


def page(url):
    return url.strip('"') != BLANK


class Replay:
    """One log in order: a stack per frame family, and the edge of every node."""

    def __init__(self, events):
        self.edges, self.born, self.resort, self.over = {}, {}, {}, set()
        self.stacks, self.targets, self.history, self.opened = {}, {}, {}, None
        self.inserted, self.announced, self.reasons = set(), set(), set()
        self.family = self.families(events)
        for seq, (kind, f, args) in enumerate(events):
            self.seq = seq
            getattr(self, kind)(f, args)
        for node, edge in self.resort.items():
            self.edges.setdefault(node, edge)

    @staticmethod
    def families(events):
        """The whole log's: children, and the first load after a window open."""
        up, opened = {}, None
        for kind, f, _ in events:
            if kind == "window_open":
                opened = f["frame"]
            elif kind == "child":
                if f["child_frame"] != f["frame"]:
                    up[f["child_frame"]] = f["frame"]
            elif kind == "load" and opened is not None:
                if f["frame"] != opened:
                    up[f["frame"]] = opened
                opened = None

        def root(x):
            seen = []
            while x in up and x not in seen:
                seen.append(x)
                x = up[x]
            return min(seen[seen.index(x):]) if x in seen else x
        return root

    # --- edges
    def first(self, dst, src, why):
        self.reasons.add(why)
        if dst not in self.edges:
            self.edges[dst], self.born[dst] = (src, why), self.seq

    def overwrite(self, dst, src, why):
        self.reasons.add(why)
        self.born.setdefault(dst, self.seq)
        self.edges[dst] = (src, why)

    def guarded(self, frame, dst, src, why):
        if dst and src and dst != src and page(dst) and page(src):
            self.first((frame, "URL", dst, None), (frame, "URL", src, None), why)

    def by_page(self, f, dst, why):
        if page(f["frame_url"]):
            self.guarded(f["frame"], dst, f["frame_url"], why)
        elif page(f["local_frame_root_url"]):
            self.guarded(f["local_frame_root"], dst, f["local_frame_root_url"], why)

    # --- what runs
    def stack(self, frame):
        return self.stacks.setdefault(self.family(frame), [])

    def runner(self, *frames):
        for x in frames:
            open_ = [s for s in self.stack(x) if not s[1]]
            if open_:
                frame, kind, p1, p2 = open_[-1][0]
                if kind == "compiled_script":
                    return (frame, "URL", p2 or "", None)
                return (frame, kind, p1, p2)
        return None

    def push(self, span):
        s = self.stack(span[0])
        bare = span[1] == "compiled_script" and not span[3] and all(x[1] for x in s)
        s.append((span, bare))

    def pop(self, frame, kind, fits=lambda top: True):
        s = self.stack(frame)
        if s and s[-1][0][1] == kind and fits(s[-1][0]):
            s.pop()

    # --- records
    def redirect(self, f, _):
        self.guarded(f["frame"], f["request_url"], f["redirect_url"], "Server Redirect")

    def refresh(self, f, _):
        self.by_page(f, f["refresh_url"], "Meta Refresh")

    def navigate(self, f, _):
        by = self.runner(f["frame"], f["main_frame"], f["origin_frame"])
        if by:
            self.first((f["frame"], "URL", f["url"], None), by, "JS Navigation")

    def window_open(self, f, _):
        self.opened = f["frame"]

    def child(self, f, _):
        pass

    def html(self, f, _):
        if f["frame"] not in self.inserted:
            self.inserted.add(f["frame"])
            self.announced.add(f["frame"])

    def load(self, f, _):
        dst, was_announced = (f["frame"], "URL", f["load_url"], None), f["frame"] in self.announced
        self.announced.discard(f["frame"])
        if self.opened is not None:
            link, by = (self.opened, "URL", f["load_url"], None), self.runner(self.opened)
            clicked = link in self.edges and link != dst
            if clicked or by:
                self.opened = None
                return self.overwrite(dst, link if clicked else by, "Anchor link click" if clicked else "Window Open")
        if was_announced:
            near = [(self.born[n], n) for n, (src, _) in self.edges.items()
                    if n[1:3] == ("URL", f["load_url"]) and not (src[1] == "URL" and page(src[2]))]
            if near:
                src, why = self.edges[min(near)[1]]
                self.overwrite(dst, src, why + " unknown")
        for own in (f["frame_url"], f["local_frame_root_url"]):
            if page(own):
                self.resort[dst] = ((f["frame"], "URL", own, None), "Load Frame")
                break
        self.by_page(f, f["load_url"], "Frame Load")

    def script(self, f, _):
        s = self.stack(f["frame"])
        if f["url"] and all(x[1] for x in s):
            self.by_page(f, f["url"], "Script Load")
        self.push((f["frame"], "compiled_script", f["scriptID"], f["url"]))

    def script_end(self, f, _):
        self.pop(f["frame"], "compiled_script")

    def target(self, f, _):
        self.targets[f["frame"]] = (f["current_target"], f["event"])

    def call(self, f, _, lazy=False):
        if f["frame"] in self.targets:
            target, event = self.targets.pop(f["frame"])
            name = target + ":" + f"{f['scriptID']} {f['callback_debug_name']}".strip()
            span = (f["frame"], "event_listener", name, event)
            self.push(span)
            if lazy:
                self.overwrite(span, (f["frame"], "URL", f["frame_url"], None), f"dom0_{event}_listener")

    def lazy(self, f, args):
        self.call(f, args, lazy=True)

    def call_end(self, f, _):
        self.pop(f["frame"], "event_listener", lambda top: top[2].startswith(f["current_target"]))

    def timer(self, f, _):
        self.push((f["frame"], "scheduled_action", "code", f["code"]))

    def timer_end(self, f, _):
        self.pop(f["frame"], "scheduled_action", lambda top: top[3] == f["code"])

    def animation(self, f, _):
        self.push((f["frame"], "request_animation_frame", f["callback_id"], None))

    def animation_end(self, f, _):
        self.pop(f["frame"], "request_animation_frame", lambda top: top[2] == f["callback_id"])

    def push_state(self, f, _):
        self.history[f["frame"]] = f["frame_url"]

    def pushed_state(self, f, _):
        if f["frame"] in self.history:
            self.guarded(f["frame"], f["frame_url"], self.history.pop(f["frame"]), "History Push State")

    def add_listener(self, f, args):
        event, by = args["type"][9:-9], self.runner(f["frame"], f["main_frame"])
        if by and (page(f["frame_url"]) or page(f["local_frame_root_url"])):
            self.overwrite((f["frame"], "event_listener", "t:" + args["listener"][25:], event), by, event + "_listener")

    def set_listener(self, f, _):
        by, event = self.runner(f["frame"], f["main_frame"]), f["attribute"][2:]
        if by:
            self.first((f["frame"], "event_listener", f"t:{f['scriptID']} {f['callback_debug_name']}", event), by,
                       f"on_{event}_listener")

    def set_timer(self, f, args):
        by = self.runner(f["frame"], f["main_frame"])
        if by:
            self.first((f["frame"], "scheduled_action", "code", args["handler"][9:-9]), by, "scheduled_action")

    def request(self, f, _):
        by = self.runner(f["frame"])
        if by:
            self.first((f["frame"], "request_animation_frame", f["callback_id"], None), by, "animation_callback")

    def insert(self, f, _):
        by = self.runner(f["frame"])
        if by:
            self.first((f["frame"], "URL", f["src_url"], None), by, "Dynamic Script Load")

    def attribute(self, f, _):
        by, dst = self.runner(f["frame"], f["main_frame"]), (f["frame"], "URL", f["value"][9:-9], None)
        if by and f["attribute"] == "src":
            self.first(dst, by, "Dynamic Script Load - set att")
        elif by and by != dst:
            self.first(dst, by, "Anchor link setup - set att")

    def method(self, f, args):
        by, dst = self.runner(f["frame"], f["main_frame"]), (f["frame"], "URL", args["value"][9:-9], None)
        if by and by != dst:
            self.first(dst, by, "Anchor link setup - set att method")


HEADERS = {
    "redirect": "DidReceiveMainResourceRedirect", "refresh": "DidHandleHttpRefresh", "navigate": "WillNavigateFrame",
    "window_open": "WindowOpen", "load": "WillLoadFrame", "script": "DidCompileScript",
    "script_end": "DidRunCompiledScriptEnd", "target": "DidCallHandleEventBegin", "call": "DidCallFunctionBegin",
    "lazy": "DidCompileLazyEventListener", "call_end": "DidCallHandleEventEnd", "timer": "DidFireScheduledActionBegin",
    "timer_end": "DidFireScheduledActionEnd", "animation": "ExecuteFrameRequestCallbackBegin",
    "animation_end": "ExecuteFrameRequestCallbackEnd", "push_state": "DidCallV8MethodCallback",
    "pushed_state": "DidCallV8MethodTemplate", "add_listener": "DidCallV8MethodTemplate",
    "set_timer": "DidCallV8MethodTemplate", "method": "DidCallV8MethodTemplate", "request": "RequestAnimationFrame",
    "set_listener": "DidCallV8SetAttributeEventListener", "html": "DidInsertDOMNode", "insert": "DidInsertDOMNode",
    "attribute": "DidCallV8SetAttribute", "child": "DidCreateChildFrame"}


def random_event(rng):
    kind = rng.choice([*HEADERS, "load", "load", "window_open", "script", "script", "call", "target", "html"])
    url, frame = lambda: rng.choice(URLS), rng.choice("abcde")
    f = dict(frame=frame, main_frame="a", origin_frame=rng.choice("abcde"), frame_url=rng.choice([*URLS, BLANK, BLANK]),
             local_frame_root="a", local_frame_root_url=rng.choice([URLS[0], BLANK, f'"{BLANK}"']))
    more = {
        "redirect": lambda: dict(request_url=url(), redirect_url=url()), "refresh": lambda: dict(refresh_url=url()),
        "navigate": lambda: dict(url=url()), "load": lambda: dict(load_url=url()),
        "script": lambda: dict(scriptID=rng.choice("12"), url=rng.choice([*URLS, "", ""])),
        "target": lambda: dict(current_target=rng.choice(["t", "u"]), event=rng.choice(["click", "load"])),
        "call_end": lambda: dict(current_target=rng.choice(["t", "u"])), "timer": lambda: dict(code=rng.choice("xy")),
        "timer_end": lambda: dict(code=rng.choice("xy")), "animation": lambda: dict(callback_id=rng.choice("12")),
        "animation_end": lambda: dict(callback_id=rng.choice("12")), "request": lambda: dict(callback_id=rng.choice("12")),
        "push_state": lambda: dict(interface="History", attribute="pushState"),
        "pushed_state": lambda: dict(interface="History", attribute="replaceState"),
        "add_listener": lambda: dict(interface="EventTarget", attribute="addEventListener", cpp_impl_ptr="t"),
        "set_timer": lambda: dict(interface="Window", attribute="setTimeout"),
        "method": lambda: dict(interface="Element", attribute="setAttribute"),
        "set_listener": lambda: dict(attribute="onclick", cpp_impl_ptr="t", scriptID="1", callback_debug_name="go"),
        "html": lambda: dict(node="HTML"), "insert": lambda: dict(node="SCRIPT", src_url=url()),
        "attribute": lambda: rng.choice([dict(interface="HTMLScriptElement", attribute="src", value=JSON(url())),
                                         dict(interface="HTMLAnchorElement", attribute="href", value=JSON(url()))]),
        "child": lambda: dict(child_frame=rng.choice("cde"), frame=rng.choice("ab"))}
    f |= more.get(kind, dict)()
    if kind in ("call", "lazy"):
        f |= dict(scriptID="1", callback_debug_name="go")
    args = {"add_listener": {"type": JSON("click"), "listener": FUNCTION("1 go")}, "set_timer": {"handler": JSON("x")},
            "method": {"name": JSON("href"), "value": JSON(url())}}.get(kind, {})
    return kind, f, args


def events_of(spark, logs):
    rows = [(log, seq, f"LOG::Page::{HEADERS[kind]} :", f, args, {}) for log, events in logs.items()
            for seq, (kind, f, args) in enumerate(events)]
    kind = "map<string,string>"
    return spark.createDataFrame(rows, f"log_id string, seq long, header string, fields {kind}, args {kind}, attrs {kind}")


def resolved(spark, logs):
    edges = chains.resolve_edges(chains.derive_edges(events_of(spark, logs)))
    return {(r.log_id, tuple(r.dst)): (tuple(r.src), r.reason) for r in edges.collect()}


def test_edges_equal_a_replay(spark):
    rng = random.Random(11)
    logs = {f"log{i}": [random_event(rng) for _ in range(rng.choice([5, 30, 90]))] for i in range(120)}
    done = {log: Replay(events) for log, events in logs.items()}
    want = {(log, node): edge for log, r in done.items() for node, edge in r.edges.items()}
    got = resolved(spark, logs)
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    reasons = set().union(*(r.reasons for r in done.values()), {why for _, why in want.values()})
    assert len({r for r in reasons if not r.endswith("unknown")}) == 19 and any(r.endswith("unknown") for r in reasons)


def test_a_link_to_the_page_itself_is_clicked(spark):
    base = dict(main_frame="a", origin_frame="a", local_frame_root="a", local_frame_root_url=BLANK)
    load = lambda frame, page: ("load", base | dict(frame=frame, frame_url=page, load_url="http://x/"), {})
    got = resolved(spark, {"l": [load("a", "http://home/"), ("window_open", base | dict(frame="a", frame_url="http://x/"), {}),
                                 load("w", BLANK)]})
    assert got["l", ("w", "URL", "http://x/", None)] == (("a", "URL", "http://x/", None), "Anchor link click")


def test_a_script_without_url_hides_nothing(spark):
    base = dict(frame="a", main_frame="a", origin_frame="a", frame_url="http://home/", local_frame_root="a",
                local_frame_root_url=BLANK)
    script = lambda url: ("script", base | dict(scriptID="1", url=url), {})
    end = ("script_end", base, {})
    got = resolved(spark, {"l": [script(""), script("http://s/"), end, end, script(""), end]})
    assert got == {("l", ("a", "URL", "http://s/", None)): (("a", "URL", "http://home/", None), "Script Load")}


@pytest.mark.parametrize("chunk_rows, fan", [(1, 2), (3, 2), (7, 3), (512, 64)])
def test_chunked_stacks_equal_one_stack(spark, chunk_rows, fan):
    rng = random.Random(chunk_rows)
    rows, want = [], set()
    for key in ("k1", "k2", None, "k3"):
        stack = []
        for at in range(rng.choice([1, 40, 300])):
            delta, p = rng.choice([1, -1, -1 if key == "k2" else 1]), rng.choice("ab")
            rows.append((key, at, delta, p))
            if delta > 0:
                stack.append(p)
            elif stack and stack[-1] == p:
                stack.pop()
            elif stack:
                want.add((key, at))
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "key string, at long, delta int, p string")
    got = unfit_ends(df, ["key"], "at", ["p"], lambda b, e: b["p"] == e["p"], chunk_rows, fan)
    assert {(r.key, r.at) for r in got.collect()} == {x for x in want if x[0] is not None}
