import re
from collections import Counter

import numpy as np

from adtrail.llm.minhash import (drop_near_duplicates, near_duplicates, probability_jaccard,
                                 signatures, weighted)


def naive(a, b):
    """Probability Jaccard by its definition, over Counters."""
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in set(a) & set(b))


def counts(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(size, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(rows):
    """Smallest id per group of texts, by comparing all pairs."""
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    number = {}
    sets = {}
    for i, t in rows:
        c = sorted((number.setdefault(k, len(number)), n) for k, n in counts(t).items())
        sets[i] = (np.array([k for k, _ in c], np.uint64), np.array([n for _, n in c], float))
    for x, (i, t) in enumerate(rows):
        for j, u in rows[:x]:
            if (t or "") == (u or "") or probability_jaccard(sets[i], sets[j]) > 0.8 - 1e-9:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 300))))
        for _ in range(int(rng.integers(1, 8))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                copy[int(rng.integers(len(copy)))] = "edit" + str(i)
            rows.append((i, " ".join(copy)))
            i += 1
    line = " ".join(f"q{k}" for k in range(30))
    rows += [(i, line), (i + 1, line + "\n" + line), (i + 2, line + " tail"), (i + 3, None), (i + 4, ""),
             (i + 5, " \n"), (i + 6, "one two"), (i + 7, "one  two"), (i + 8, "one two three"),
             (i + 9, "x " * 20000), (i + 10, "x " * 20001)]
    return rows


def test_similarity_is_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a = {int(k): int(w) for k, w in zip(rng.integers(0, 30, 20), rng.integers(1, 5, 20))}
        b = {int(k): int(w) for k, w in zip(rng.integers(0, 30, 20), rng.integers(1, 5, 20))}
        pair = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], float)) for x in (a, b)]
        assert abs(probability_jaccard(*pair) - naive(Counter(a), Counter(b))) < 1e-12


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    w = rng.integers(-2**62, 2**62, 300)
    with np.errstate(over="ignore"):
        one, two = weighted(w), weighted(np.concatenate([w[:270], w[200:260]]))
        keys = [one[0], two[0]]
        sig = signatures(np.repeat([0, 1], [len(k) for k in keys]), np.concatenate(keys),
                         np.concatenate([one[1], two[1]]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - probability_jaccard(one, two)) < 0.03


def test_groups_match_brute_force(make_docs):
    rows = corpus()
    want = brute(rows)
    got = near_duplicates(make_docs(rows)).collect()
    assert {r.doc_id: r.group_id for r in got} == want
    text = dict(rows)
    low = {}
    for i, t in rows:
        low.setdefault(t or "", i)
    assert all(r.copy_id == low[text[r.doc_id] or ""] for r in got)


def test_one_of_each_group_stays(make_docs):
    rows = corpus()
    want = brute(rows)
    docs = make_docs(rows + [rows[0], rows[0], (None, rows[5][1]), (None, "only without an id at all here")])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 1


def test_hot_group_with_borderline_links(make_docs):
    """Members of a large group that the first pivot does not reach are still linked."""
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        for k in rng.choice(200, 2, replace=False):
            copy[k] = f"e{i}_{k}"
        rows.append((i, " ".join(copy)))
    assert {r.doc_id: r.group_id for r in near_duplicates(make_docs(rows)).collect()} == brute(rows)


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert drop_near_duplicates(make_docs([])).count() == 0
