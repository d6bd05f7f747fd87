import random
import re
import zlib
from collections import Counter

import pytest

from adtrail.llm.q_spellings import op12_spelling_variants
from adtrail.llm.spellings import variant_groups, word_counts

SF = "/root/testdata/sf0.001"


def brute_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(counts, min_length=5, min_count=3):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, out = {}, []
    for w, n in words.items():
        close = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best is not None and words[best] >= 2 * n else None, len(close))
    for w, n in words.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n, forms[w][1], words.get(form)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("length", [3, 7, 70])
def test_groups_match_brute_force(spark, length):
    rng = random.Random(length)
    stem = "".join(rng.choice("ab") for _ in range(length))
    words = {stem, "é" * 5, "é" * 6, "÷é×éé", "÷é×é", "aaaaa", "aaaa", "aaaaaa", "abcde", "bcdea"}
    while len(words) < 300:
        w = rng.choice(sorted(words))
        i, c = rng.randrange(len(w) + 1), rng.choice("abé")
        words.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]]))
    counts = {w: rng.choice([1, 2, 3, 4, 8, 17, 40]) for w in sorted(words)}
    rows = [(w, n) for w, n in counts.items()] + [("aaaaa", 5), (None, 9)]
    counts["aaaaa"] += 5
    df = spark.createDataFrame(rows, "word string, n long")
    assert got(variant_groups(df, 2, 2)) == brute_groups(counts, 2, 2)


def test_words_match_brute_force(spark, make_docs):
    rng = random.Random(1)
    runs = ["".join(rng.choice("abÉÀZé") for _ in range(rng.randint(1, 9))) for _ in range(600)]
    rows = [(i, rng.choice([" ", "1", "\n", "ā", "_"]).join(rng.sample(runs, 40))) for i in range(60)]
    rows += [(None, "ABCDE abcde"), (3, None), (4, ""), (5, " 12 "), (7, "İx ſ K"), (8, rows[8][1]), (8, rows[8][1])]
    want = brute_counts(rows)
    for held in (30, 400_000):
        df = word_counts(make_docs(rows), held=held)
        assert {r.word: r.n for r in df.collect()} == dict(want)
    assert got(variant_groups(word_counts(make_docs(rows)), 1, 1)) == brute_groups(want, 1, 1)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_spelling_variants(spark, SF)) == brute_groups(brute_counts(rows))


def test_very_long_words_and_empty_table(spark, make_docs):
    long = "abcdefghij" * 800
    rows = [(1, f"{long} {long} {long} {long} {long} {long} {long[:-1]} " * 3 + long[:4000] + "é" + long[4001:] + " x")] * 3
    assert got(variant_groups(word_counts(make_docs(rows)))) == brute_groups(brute_counts(rows))
    assert variant_groups(word_counts(make_docs([]))).count() == 0
    assert variant_groups(word_counts(make_docs([(1, None), (2, "1 2 3")]))).count() == 0
