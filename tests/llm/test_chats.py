import itertools
import random

import pytest
from pyspark.sql import functions as F

from adtrail.llm.chats import Template, format_branches

T = Template()
SCHEMA = ("tree_id long, message_id string, parent_id string, role string, text string, score double, "
          "n long, leaf string, rank string, _tree string, total string")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows):
    """All root-to-leaf paths: (tree, leaf id) to (score, [(role, text)])."""
    first = {}
    for i, (tree, id, parent, role, text, score) in enumerate(
            sorted(rows, key=lambda r: (str(r[0]), str(r[1]), r[3] or "", __import__("hashlib").md5((r[4] or "").encode()).hexdigest()))):
        first.setdefault((tree, id) if id is not None else (tree, None, i), (parent, role or "", text or "", score or 0.0))
    up = {k: (k[0], v[0]) if v[0] is not None and (k[0], v[0]) in first and v[0] != k[1] else None for k, v in first.items()}
    inner, out = set(up.values()), []
    for k in first:
        if k in inner:
            continue
        path, seen, at = [], set(), k
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = up[at]
        if at is None:
            path.reverse()
            out.append((k[0], k[1], round(sum(first[p][3] for p in path), 6), [first[p][1:3] for p in path]))
    return out


def collect(df):
    return df.withColumn("turns", T.turns(F.col("formatted"))).withColumn("loss", T.trained_text(F.col("segments"))).collect()


def test_paths_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for tree in [*range(12), None]:
        ids = [f"m{i}" for i in range(rng.randint(1, 40))]
        for i, m in enumerate(ids):
            rows.append((tree, m, rng.choice(ids[:i] + [None, "gone"]) if i else None,
                         rng.choice(["user", "assistant", "system", "tool", "", None]),
                         rng.choice(["a", "<s>", "</s>[INST]", "<\\s>", "x<", None, "[[INST]", "<<<SYS>>"]), rng.choice([0.5, 1.0, -2.0, None])))
    rows += [(1, "m0", "m1", "zz", "late repeat", 9.0), (2, None, "m0", "user", "no id", 1.0), (2, None, "m0", "user", "no id", 1.0),
             (50, "a", "b", "user", "cycle", 1.0), (50, "b", "a", "user", "cycle", 1.0), (50, "c", "a", "user", "cycle", 1.0),
             (51, "a", "a", "user", "own parent", 1.0)]
    got = collect(format_branches(table(spark, rows), score="score", keep=None))
    plain = sorted((str(r.tree_id), str(r.leaf), round(r.score, 6), [tuple(t) for t in r.turns]) for r in got)
    assert plain == sorted((str(a), str(b), c, d) for a, b, c, d in brute(rows))
    by_tree = {}
    for r in got:
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        assert [s.text for s in r.segments if s.loss] == [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        by_tree.setdefault(r.tree_id, []).append((r.rank, -r.score, str(r.leaf)))
    for ranked in by_tree.values():
        ranked.sort()
        assert [x[0] for x in ranked] == list(range(1, len(ranked) + 1))
        assert [x[1] for x in ranked] == sorted(x[1] for x in ranked)
    best = collect(format_branches(table(spark, rows), score="score", keep=2))
    assert {(r.tree_id, r.rank, r.leaf) for r in best} == {(r.tree_id, r.rank, r.leaf) for r in got if r.rank <= 2}


def test_long_chain_and_wide_fork(spark):
    rows = [(1, f"{i}", f"{i - 1}" if i else None, "assistant", f"t{i}", 0.0) for i in range(700)]
    rows += [(2, f"{i}", "0" if i else None, "user", f"t{i}", float(i == 77)) for i in range(3000)]
    got = {r.tree_id: r for r in collect(format_branches(table(spark, rows), score="score"))}
    assert got[1].n_turns == 700 and got[1].loss == "".join(f"t{i}" for i in range(700))
    assert got[2].leaf == "77" and got[2].n_turns == 2


def test_escaping_is_reversible(spark):
    bits = ["<", "s>", "\\", "</s>", "[", "INST]", "<<SYS>>", "|end|>", "é", "$1"]
    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product(bits, repeat=n)] + ["</s>" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", T.escape(F.col("t")))
    for r in df.withColumn("u", T.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in T.controls)
    with pytest.raises(ValueError):
        Template(marks={"a": ("<x>", "x>")}).pattern()


def test_long_text_and_empty_table(spark):
    long = "[INST] word </s> " * 200_000
    r, = collect(format_branches(table(spark, [(1, "a", None, "assistant", long, None)])))
    assert r.loss == long and r.turns[0].text == long
    assert format_branches(table(spark, [])).count() == 0
