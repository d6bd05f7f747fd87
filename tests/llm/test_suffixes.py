import hashlib
from collections import Counter

import numpy as np
import pytest

import adtrail.llm.suffixes as suffixes
from adtrail.llm.suffixes import _decode, _front_code, merge, remove_repeats, repeat_digests


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = 1
        gone = gone[:len(t)]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus():
    rng = np.random.default_rng(4)
    words = ["ab", "über", "the", "stein", "x", "né", "weltlich", "of", "und"]
    prose = lambda n: " ".join(rng.choice(words, n)) + str(rng.integers(10**9))
    shared = [prose(60) for _ in range(4)] + ["y" * 230, "zq" * 150]
    texts = [None, "", "short", "q" * 199, "r" * 200, "s" * 201, "t" * 500]
    for _ in range(60):
        parts = [prose(int(rng.integers(5, 80)))]
        for _ in range(int(rng.integers(0, 3))):
            s = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, 40))
            parts += [s[a:len(s) - int(rng.integers(0, 40))], prose(int(rng.integers(1, 50)))]
        texts.append("".join(parts))
    whole = texts[-1]
    texts += [whole, whole + "!", "pre" + texts[-2], texts[-3].replace("the", "tha", 1)]
    return texts


def test_front_coded_runs_merge_in_order():
    rng = np.random.default_rng(1)
    keys = [bytes(rng.integers(97, 99, int(rng.integers(0, 12))).tolist()) for _ in range(300)]
    for k in (1, 2, 3, 7, 16):
        runs, want = [], Counter(keys)
        for i in range(k):
            own = Counter(keys[i::k])
            runs.append(_decode(_front_code([(x, [(i, 0)] * n) for x, n in sorted(own.items())])))
        got, last = Counter(), b""
        for key, shared, refs in merge(runs):
            assert key >= last
            n = 0
            while n < min(len(key), len(last)) and key[n] == last[n]:
                n += 1
            assert shared == n
            got[key] += len(refs)
            last = key
        assert got == want


@pytest.mark.parametrize("task_bytes", [1 << 20, 1 << 9])
def test_matches_brute_force(make_docs, monkeypatch, task_bytes):
    """Also with texts longer than what is hashed at once."""
    monkeypatch.setattr(suffixes, "TASK_BYTES", task_bytes)
    texts = corpus()
    rows = list(enumerate(texts)) + [(None, texts[30]), (20, texts[20])]
    got = sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                            for r in repeat_digests(make_docs(rows)).collect())))
    want = brute([t for _, t in rows])
    assert got == sorted(repr((i, *w[:4])) for (i, _), w in zip(rows, want))


def test_text_is_cut_and_columns_stay(make_docs):
    texts = corpus()
    docs = make_docs(list(enumerate(texts)))
    cut = remove_repeats(docs)
    assert cut.columns == docs.columns
    want = brute(texts)
    for r in cut.collect():
        if texts[r.doc_id] is None:
            assert r.text is None
        else:
            assert r.text == want[r.doc_id][4].decode("utf-8", "ignore") and r.n_chars == len(r.text)


def test_empty_table(make_docs):
    assert repeat_digests(make_docs([])).count() == 0
    assert repeat_digests(make_docs([(1, None), (2, "")])).count() == 2
