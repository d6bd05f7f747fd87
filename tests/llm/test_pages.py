import itertools
import math
import re
from html import unescape

import numpy as np
import pytest

from adtrail.llm.pages import extract_pages, main_text, marginals, train

SF = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet(SF))


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    for n in (2, 5, 9):
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = [0.0] + [float(x) for x in rng.normal(size=n - 1) * 2]
        edges = [[list(map(float, np.log(rng.dirichlet([1, 1])))) for _ in (0, 1)] for _ in range(n)]
        weight, one = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n - 1):
            y = (0, *y)
            w = math.exp(sum(odds[i] * y[i] + edges[i][y[parent[i]]][y[i]] for i in range(1, n)))
            weight += w
            one += w * np.array(y)
        assert np.allclose(marginals(parent, odds, edges)[1:], (one / weight)[1:])


def test_given_pages(spark):
    """The article of the given pages, by a plain pattern."""
    pages = spark.read.parquet(SF)
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        blocks = re.split(r"</?(?:p|h1)>", body[1] if body else "")
        blocks = [re.sub(r"<[^>]*(?:>|\Z)", " ", b) for b in blocks]
        want = "\n".join(b for b in (re.sub(r"\s+", " ", unescape(b)).strip() for b in blocks) if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


PROSE = "It was a long day, and the <b>river</b> ran &amp; ran.\n  Nobody knew why it did so."
CLEAN = "It was a long day, and the river ran & ran. Nobody knew why it did so."


@pytest.mark.parametrize("page", [
    f"<body><nav><a href=x>Home</a></nav><main><p>{PROSE}</p><p>{PROSE}</main><footer><p>All rights.</p></footer>",
    f"<div id=header><p>Welcome here.</p></div><div class='post-content'><p>{PROSE}<p>{PROSE}</div>"
    f"<div class=sidebar><p>{PROSE}</p></div>",
    f"<article><p>{PROSE}</p><aside><p>{PROSE}</p></aside><div class='ad'>Buy now.</div><p>{PROSE}</p>"
    f"<section class='comments'><p>{PROSE}</p></section><form><p>Your name.</p></form></article>",
    f"<article><script>var a='<p>x</p>'</script><style>p{{}}</style><p>{PROSE}</p><!-- <p>x</p> --><p>{PROSE}",
    f"<div class=cookie-notice><p>{PROSE}</p></div><article><p>{PROSE}</p><p>{PROSE}</p></article><p hidden>no</p>",
])
def test_boilerplate_goes(model, page):
    assert main_text(page, model) == f"{CLEAN}\n{CLEAN}"


def test_edge_cases(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just < words & <"), (None, "u", "<article>x<p"),
            (5, "u", "<article>" + "<div>" * 4 + "deep down here." + "</div>" * 4 + "</article>"),
            (6, "u", "<a b='" * 300), (7, "u", "<article><p>" + "long text. " * 20000), (2, None, ""),
            (8, "u", "<div>" * 5000 + "<a><p>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows],
                               "page_id long, url string, html string, _row string, text string")
    got = extract_pages(df, model=model).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == "" and text[None] == "x" and text[5] == "deep down here."
    assert text[7] == ("long text. " * 20000).strip()
    assert extract_pages(df.limit(0)).count() == 0
