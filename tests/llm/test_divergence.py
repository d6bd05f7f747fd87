import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adtrail.llm.divergence import _share, source_divergence, terms

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=50, a=5):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(PATTERN.findall((text or "").translate(ASCII)))
        groups[lang].add(source)
        n[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        share = {}
        for s in [*sources, None]:
            c = sum((n[lang, x] for x in sources), Counter()) if s is None else n[lang, s]
            total = sum(c[t] for t in kept) + a * len(kept)
            share[s] = {t: 1 + 10**9 * (c[t] + a) // total for t in kept}
        for s in sources:
            pair = [(-sum(abs(share[s][t] - share[x][t]) for t in kept), x.encode(), x) for x in sources - {s}]
            term = [(share[None][t] - share[s][t], t.encode(), t) for t in kept
                    if n[lang, s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, x, -v, i + 1) for i, (v, _, x) in enumerate(found)]
    return sorted(out)


def make(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "x", "x") for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n string, term string, item string")


def rows_of(rng, count):
    words = [f"{a}{b}" for a in "abcdeÉéß中🙂" for b in ("", "X", "y", "É", "zz")] + ["the", "The", "é" * 40]
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", "-", "1", "\n", "[", "\x00", "'"]) for _ in range(rng.randint(0, 30)))
        yield rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "Ä", "z", None, "s1"])


@pytest.mark.parametrize("tiles", [{}, {"tile_terms": 7, "tile_sources": 2, "held": 20}])
def test_matches_brute_force(spark, tiles):
    rows = list(rows_of(random.Random(5), 400))
    rows += [("rare only", "fr", "s1"), ("other", "fr", "s2"), (None, "fr", None), ("alone", "xx", "one")] + [("same text", "en", "s1")] * 50
    got = sorted(tuple(r) for r in source_divergence(make(spark, rows), min_docs=8, **tiles).collect())
    assert got == brute(rows, 8)


def test_terms_follow_the_pattern():
    text = "".join(chr(c) for c in range(0x250)) + "A[B`c{D\x7fE\x80f é中 x"
    assert [t.decode() for t in terms(text.encode())] == PATTERN.findall(text.translate(ASCII))


def test_shares_are_exact(spark):
    pairs = [(5, 5), (1, 3), (9 * 10**14, 9 * 10**15), (8_999_999_999_999_999, 9 * 10**15), (5, 10**15 + 7), (0, 0)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("p", _share(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.p == 1 + (10**9 * r.a // r.b if r.b else 0)


def test_empty_and_wordless_tables(spark):
    assert source_divergence(make(spark, [])).count() == 0
    rows = [(None, None, "a"), ("", None, "b"), ("1 2", "", "c")]
    assert sorted(tuple(r) for r in source_divergence(make(spark, rows)).collect()) == brute(rows, 30)


def test_long_text(spark):
    rows = [("word " * 400_000 + f"x{i % 3}", "en", f"s{i % 2}") for i in range(31)]
    assert sorted(tuple(r) for r in source_divergence(make(spark, rows)).collect()) == brute(rows, 30)
