import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from adtrail.llm.mixing import mix_documents, mixture_blocks, mixture_counts, permute, source_targets


def targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """Iterative resharing, as the rule is stated."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = budget * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / max(1e-300, sum(w[s] for s in rest)) if rest else 0
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return {**full, **{s: level * w[s] for s in rest}}
        full |= {s: cap * sizes[s] for s in over}


def docs_of(n_by_source, seed=1):
    rng, rows, i = np.random.default_rng(seed), [], 0
    for s, n in n_by_source.items():
        for _ in range(n):
            rows.append((i, " ".join(f"d{i}w{j}" for j in range(int(rng.integers(0, 400)))), s))
            i += 1
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permute_is_a_permutation(n):
    p = permute(np.arange(n), n, 12345)
    assert sorted(p) == list(range(n))
    assert n < 64 or (p != np.arange(n)).any()


def test_targets_and_taken(make_docs):
    rows = docs_of({"a": 12, "b": 150, "c": 9, "ä": 30, None: 20, "z": 1})
    rows += [(900, None, "a"), (901, "", "empty"), rows[0], rows[0]]
    got = mixture_counts(make_docs(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes, source = defaultdict(int), {}
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source[i] = s
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64
    again = mixture_counts(make_docs(rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_documents_and_blocks_hold_the_words_taken(make_docs):
    rows = docs_of({"a": 10, "b": 60, "c": 30})
    docs = make_docs(rows)
    taken = {r.doc_id: r.taken for r in mixture_counts(docs).collect()}
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    got, words, whole = Counter(), Counter(), {i: t for i, t, _ in rows}
    for r in mixed.collect():
        w = r.text.split()
        got[r.doc_id] += len(w)
        words.update(w)
        it = iter(whole[r.doc_id].split())
        assert all(x in it for x in w) and r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(got)
    blocks = mixture_blocks(docs, shard_slots=50).collect()
    assert Counter(x for r in blocks for x in r.words) == words
    assert max(len(r.words) for r in blocks) == 64
    per_shard = Counter(r.shard for r in blocks)
    assert len(per_shard) > 3 and max(per_shard.values()) < 100


def test_empty_table(make_docs):
    assert mixture_counts(make_docs([])).count() == 0
    assert mix_documents(make_docs([(1, None), (2, " ")])).count() == 0


def test_targets_of_more_sources_than_one_task_takes(spark):
    n = 120_000
    sized = spark.range(n).selectExpr("concat('0', lpad(id, 6, '0')) as _s", "1 + id * 7919 % 1000 as size")
    got = source_targets(sized).toPandas().sort_values("_s")
    size = 1 + np.arange(n) * 7919 % 1000
    assert (got["source_size"].to_numpy() == size).all()
    w = np.array([5.0, 2.0, 1.0])[np.arange(n) % 3]
    low, high = 0.0, 1e6
    for _ in range(200):  # the level at which the budget is used up
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(2.0 * size, mid * w).sum() < 1.5 * size.sum() else (low, mid)
    assert np.allclose(got["target"], np.minimum(2.0 * size, low * w), rtol=1e-9)
