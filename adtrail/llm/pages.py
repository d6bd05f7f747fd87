"""Main text of HTML pages by a tree-structured graphical model.

Every element of the DOM is a binary variable, content or not. Node potentials come from the tag,
the words of class and id, link density and the shape of the text; edge potentials tie a child to
its parent, apart inside and outside of marked boilerplate. Messages go up the tree and down again
(sum-product), which gives the exact marginal of each element; text is kept where it is at least
one half. Potentials are trained from pages whose markup says where the article is (an ``article``
or ``main`` element), plus fixed pseudo-counts for markup that those pages may lack.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Words of markup and how elements behave.
ARTICLE_TAGS = ("article", "main")
BOILER_TAGS = ("nav", "aside", "footer", "header", "form", "menu", "dialog")
BOILER_WORDS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header",
    "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing",
    "social", "comment", "comments", "reply", "replies", "discussion", "disqus", "cookie", "cookies",
    "consent", "notice", "alert", "popup", "modal", "overlay", "subscribe", "newsletter", "signup", "login",
    "form", "search", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "skip", "tracking",
)
CONTENT_WORDS = ("article", "content", "post", "entry", "story", "main", "body", "text", "prose")
INLINE_TAGS = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
    "wbr"))
#: Text in these never shows: everything up to the end tag is left out.
RAW_TAGS = frozenset(("script", "style", "title", "textarea", "template", "noscript", "iframe", "xmp"))
SKIP_TAGS = frozenset(("head", "select", "option", "button", "svg", "object", "canvas", "audio", "video"))
#: A start tag of the first kind closes an open element of these kinds above the nearest block.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}

#: Pseudo-counts for each boilerplate tag or word, and for each word of content.
PRIOR = 50.0
#: Largest weight of one feature in log odds, by kind.
LIMITS = {"tag": 2.0, "mark": 6.0, "word": 1.5, "links": 1.0, "length": 1.0, "stop": 1.0}
#: Part of the edge potentials that is uniform, outside and inside marked boilerplate.
LOOSE = (0.05, 0.001)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_BOILER, _CONTENT = frozenset(BOILER_WORDS), frozenset(CONTENT_WORDS)


class Dom:
    """Elements in page order: ``parent``, ``tag``, ``attrs``; ``texts`` are (element, text) and
    None where a block ends or begins."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], [""], [""]
        self.texts: list[tuple[int, str] | None] = []
        stack, at, skip = [0], 0, 0
        pos, n = 0, len(source)
        while pos < n:
            lt = source.find("<", pos)
            found = None
            while lt >= 0:
                found = _TOKEN.match(source, lt)
                if found:
                    break
                lt = source.find("<", lt + 1)
            end = lt if lt >= 0 else n
            if end > pos and not skip:
                self.texts.append((stack[-1], html.unescape(source[pos:end])))
            if not found:
                break
            pos = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing = name.lower(), found[1] or found[4]
            if closing:
                skip = self._close(stack, name, skip)
                continue
            attrs = found[3] or found[6] or ""
            if name in RAW_TAGS:
                close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(source, pos)
                pos = close.end() if close else n
                if name not in INLINE_TAGS and name not in ("script", "style"):
                    self.texts.append(None)
                continue
            if name == "br":
                self.texts.append((stack[-1], " "))
                continue
            if name not in INLINE_TAGS:
                self.texts.append(None)
                skip = self._open(stack, name, skip)
            if name in VOID_TAGS or attrs.endswith("/"):
                continue
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.attrs.append(attrs)
            stack.append(len(self.tag) - 1)
            skip += name in SKIP_TAGS

    def _pop(self, stack, depth, skip):
        while len(stack) > depth:
            skip -= self.tag[stack.pop()] in SKIP_TAGS
        return skip

    def _open(self, stack, name, skip):
        """Ends what a block start tag ends without saying so: a paragraph, a list item, a cell."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == "p" or tag in CLOSES.get(name, ()):
                return self._pop(stack, k, skip)
            if tag not in INLINE_TAGS and not (tag[0] == "h" and tag[1:].isdigit()):
                break
        if name == "body":
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "head":
                    return self._pop(stack, k, skip)
        return skip

    def _close(self, stack, name, skip):
        inline = name in INLINE_TAGS
        if not inline:
            self.texts.append(None)
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                return self._pop(stack, k, skip)
            if inline and tag not in INLINE_TAGS:
                break
        return skip


def _bucket(n: int) -> int:
    return min(8, n.bit_length())


def features(dom: Dom) -> tuple[list[list[str]], list[bool]]:
    """Features of each element, and whether it stands inside marked boilerplate."""
    n = len(dom.tag)
    size, linked, own, stops = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[dom.parent[i]] or dom.tag[i] == "a"
    for x in dom.texts:
        if x:
            k = len(x[1].strip())
            own[x[0]] += k
            stops[x[0]] += sum(x[1].count(c) for c in ".!?")
            size[x[0]] += k
            linked[x[0]] += k if in_link[x[0]] else 0
    for i in range(n - 1, 0, -1):
        size[dom.parent[i]] += size[i]
        linked[dom.parent[i]] += linked[i]
    out, marked = [[]], [False]
    for i in range(1, n):
        tag = dom.tag[i]
        names = " ".join("".join(m) for m in _NAMES.findall(dom.attrs[i])).lower()
        words = set(re.findall(r"[a-z]+", names))
        boiler = tag in BOILER_TAGS or bool(words & _BOILER) or bool(_HIDDEN.search(dom.attrs[i]))
        content = tag in ARTICLE_TAGS or bool(words & _CONTENT)
        f = [f"tag {tag}", *[f"word {w}" for w in sorted(words)]]
        if boiler and not (content and tag not in BOILER_TAGS):
            f.append("mark boiler")
        elif content:
            f.append("mark article" if tag in ARTICLE_TAGS else "mark content")
        if size[i]:
            f.append(f"links {min(3, 4 * linked[i] // size[i])}")
        if own[i]:
            f += [f"length {_bucket(own[i])}", f"stop {min(2, stops[i])}"]
        out.append(f)
        marked.append(marked[dom.parent[i]] or "mark boiler" in f)
    return out, marked


def _silver(dom: Dom, marked: list[bool]) -> list[int] | None:
    """Labels of a page whose markup names its article; None for other pages."""
    if not any(t in ARTICLE_TAGS for t in dom.tag):
        return None
    y = [0] * len(dom.tag)
    for i in range(1, len(y)):
        inside = y[dom.parent[i]] or dom.tag[i] in ARTICLE_TAGS
        y[i] = int(bool(inside) and not marked[i])
    return y


def _count(batches):
    """Arrow batches (html) to counts of (what, label) over labelled pages."""
    total: Counter = Counter()
    for batch in batches:
        for source in batch.column(0).to_pylist():
            dom = Dom(source)
            f, marked = features(dom)
            y = _silver(dom, marked)
            if y is None:
                continue
            for i in range(1, len(y)):
                total["all", y[i]] += 1
                for x in f[i]:
                    total[x, y[i]] += 1
                total[f"edge {int(marked[i])} {y[dom.parent[i]]}", y[i]] += 1
    yield pa.RecordBatch.from_pydict({
        "what": pa.array([k for k, _ in total], pa.string()),
        "label": pa.array([y for _, y in total], pa.int32()),
        "n": pa.array(list(total.values()), pa.int64())})


#: Features kept by the model, most frequent first.
MAX_FEATURES = 4096


def train(pages: DataFrame, source: str = "html", max_features: int = MAX_FEATURES) -> dict:
    """Weights of the potentials from all labelled pages; without any, the pseudo-counts decide.

    The model has at most ``max_features`` features, so what the driver takes is bounded.
    """
    counts = pages.select(F.coalesce(F.col(source), F.lit("")).alias("h")).mapInArrow(
        _count, "what string, label int, n bigint")
    rows = counts.groupBy("what").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1")).orderBy(
        F.col("what").rlike("^(all$|edge )").desc(), (F.col("n0") + F.col("n1")).desc(), "what").limit(
        max_features).collect()
    n = {r.what: [float(r.n0), float(r.n1)] for r in rows}
    for t in BOILER_TAGS:
        n.setdefault(f"tag {t}", [0.0, 0.0])[0] += PRIOR
    for mark, label in (("boiler", 0), ("article", 1), ("content", 1)):
        n.setdefault(f"mark {mark}", [0.0, 0.0])[label] += PRIOR
    for label, words in ((0, BOILER_WORDS), (1, CONTENT_WORDS)):
        for w in words:
            n.setdefault(f"word {w}", [0.0, 0.0])[label] += PRIOR
    n0, n1 = n.get("all", [0.0, 0.0])
    odds = {}
    for what, (a, b) in n.items():
        kind = what.split(" ")[0]
        if kind in LIMITS:
            limit = LIMITS[kind]
            w = math.log((b + 1) / (n1 + PRIOR)) - math.log((a + 1) / (n0 + PRIOR))
            odds[what] = max(-limit, min(limit, w))
    edges = {}
    for inside in (0, 1):
        for parent in (0, 1):
            a, b = n.get(f"edge {inside} {parent}", [0.0, 0.0])
            a, b = a + (20.0, 1.0)[parent], b + (1.0, 20.0)[parent]
            loose = LOOSE[inside] if parent == 0 else LOOSE[0]
            if inside and parent:  # marked boilerplate inside an article
                a, b = 1.0, 1.0
            edges[inside, parent] = [math.log((1 - loose) * x / (a + b) + loose / 2) for x in (a, b)]
    return {"odds": odds, "edges": edges}


def _add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def marginals(parent: list[int], odds: list[float], edges: list[list[list[float]]]) -> list[float]:
    """Probability of label 1 per node of a tree whose parents come before their children.
    ``edges[i][y_parent][y]`` in logs; node 0 is the root, with label 0."""
    n = len(parent)
    up = [[0.0, odds[i]] for i in range(n)]  # potential times the messages from the children
    sent: list = [None] * n
    for i in range(n - 1, 0, -1):
        e, u = edges[i], up[i]
        m = [_add(e[y][0] + u[0], e[y][1] + u[1]) for y in (0, 1)]
        sent[i] = m
        p = up[parent[i]]
        p[0] += m[0]
        p[1] += m[1]
    down = [[0.0, 0.0] for _ in range(n)]  # message from the parent
    down[0] = [0.0, -math.inf]
    out = [0.0] * n
    for i in range(1, n):
        p, m, e = parent[i], sent[i], edges[i]
        rest = [up[p][y] + down[p][y] - m[y] for y in (0, 1)]  # belief of the parent without i
        d = [_add(rest[0] + e[0][y], rest[1] + e[1][y]) if rest[1] > -math.inf else rest[0] + e[0][y]
             for y in (0, 1)]
        top = max(d)
        down[i] = [d[0] - top, d[1] - top]
        b0, b1 = up[i][0] + down[i][0], up[i][1] + down[i][1]
        out[i] = 1.0 / (1.0 + math.exp(min(700.0, b0 - b1)))
    return out


def main_text(source: str, model: dict) -> str:
    dom = Dom(source)
    f, marked = features(dom)
    odds = [sum(model["odds"].get(x, 0.0) for x in own) for own in f]
    edges = [[model["edges"][int(m), 0], model["edges"][int(m), 1]] for m in marked]
    keep = marginals(dom.parent, odds, edges)
    blocks, block = [], []
    for x in [*dom.texts, None]:
        if x is None:
            text = _SPACE.sub(" ", "".join(block)).strip(" ")
            if text:
                blocks.append(text)
            block = []
        elif keep[x[0]] >= 0.5:
            block.append(x[1])
    return "\n".join(blocks)


def _extract(batches, model: dict):
    for batch in batches:
        texts = [main_text(s, model) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["_row", "text", "n_chars"])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html",
                  model: dict | None = None) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    NULL counts as an empty page, whose text is empty, as it is for a page without an article.
    Broken and cut-off markup is read as far as it goes. Repeated rows keep their rows, an empty
    table gives no rows, and further columns are ignored whatever their names.
    """
    model = model or train(pages, source)
    rows = pages.select(F.struct(F.col(page_id).alias("i"), F.col(url).alias("u")).alias("_row"),
                        F.coalesce(F.col(source), F.lit("")).alias("_html"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    return rows.mapInArrow(partial(_extract, model=model),
                           f"_row struct<i:{kinds[0]},u:{kinds[1]}>, text string, n_chars bigint").select(
        F.col("_row.i").alias(page_id), F.col("_row.u").alias(url), "text", "n_chars")
