import math
import re
import zlib
from collections import Counter

import numpy as np

from adtrail.llm.maxent import BUCKETS, CLASSES, _history, _log_softmax, language_scores

SF = "/root/testdata/sf0.01/documents.parquet"


def brute(rows):
    def cut(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n,
             sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in cut(t))) for i, t in rows]


def test_counts_and_base_scores(make_docs):
    rows = [(i, " ".join(f"W{(i * k) % 37}É" for k in range(i % 50))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "new words only\nhere"), (None, "x y"), (3, rows[3][1]),
             (503, "long " * 30000)]
    got = language_scores(make_docs(rows), block_bytes=3000).collect()
    key = lambda r: (r[0] is None, r[0], r[2])
    for g, w in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and abs(g.base_score - w[5]) < 1e-6 * max(1, -w[5])
        assert g.score <= 1e-9 and math.isfinite(g.score)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    got = language_scores(spark.read.parquet(SF)).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    rows = _history(rng.integers(0, 40, 50), rng.integers(0, BUCKETS, 50), np.arange(50) % 17 == 0)
    w = rng.normal(size=(BUCKETS, CLASSES))
    assert np.allclose(np.exp(_log_softmax(rows, w, np.zeros(CLASSES))).sum(axis=1), 1)


def test_empty_table(make_docs):
    assert language_scores(make_docs([])).count() == 0
    assert language_scores(make_docs([(None, "held out")])).first().score <= 1e-9
