"""Skew-proof scans, banded joins, components and clusters against brute force."""

import random

import pytest
from pyspark.sql import Window, functions as F

from adtrail.operators import cluster
from adtrail.operators.records import nesting, pair_next
from adtrail.plans import cut, similarity
from adtrail.plans.components import roots
from adtrail.plans.groups import number_rows, ordered, top_per
from adtrail.functions import bits
from adtrail.plans.similarity import bit_order, near_known, near_pairs


def bits_apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def hash_families(seed, families=12, size=10, spread=9):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = rng.getrandbits(128)
        for _ in range(size):
            h = base
            for _ in range(rng.randint(0, spread)):
                h ^= 1 << rng.randrange(128)
            out.append(f"{h:032x}")
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.choice([None, 1, 2, -1])) for i in range(900)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at int, v int")


@pytest.mark.parametrize("limit", [10, 10**9])
def test_scans_equal_plain_windows(skewed, limit):
    w = Window.partitionBy("k").orderBy("at")
    want = skewed.select(
        "k", "at", F.last("v", True).over(w).alias("last"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        F.lag("v").over(w).alias("lag"), F.sum("v").over(w).alias("total"),
        F.min("v").over(w).alias("low"))
    g = ordered(skewed, ["k"], ["at"], min_hot_rows=limit)
    assert g.split == (limit == 10)
    g = g.last(F.col("v"), "last").last(F.col("v"), "before", before=True).next(F.col("v"), "next")
    g = g.previous_row(F.col("v"), "_p").running_sum(F.col("v"), "total").running_min(
        F.col("v"), "low")
    got = g.result().select("k", "at", "last", "before", "next", F.col("_p.v").alias("lag"),
                            "total", "low")
    assert sorted(got.collect(), key=lambda r: r.at) == sorted(want.collect(), key=lambda r: r.at)


@pytest.mark.parametrize("limit", [10, 10**9])
def test_nesting_equals_a_stack(spark, skewed, limit):
    df = skewed.select("k", "at", F.coalesce("v", F.lit(0)).alias("v")).select(
        "k", "at", F.when(F.col("v") == 2, 1).otherwise(F.col("v")).alias("d"))
    got = {r["at"]: (r["level"], r["open"]) for r in nesting(
        df, ["k"], ["at"], "d", F.col("at"), min_hot_rows=limit).collect()}
    stacks = {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        stack = stacks.setdefault(r["k"], [])
        if r["d"] > 0:
            stack.append(r["at"])
        want = (len(stack), stack[-1] if stack else None)
        if r["d"] < 0 and stack:
            stack.pop()
        assert got[r["at"]] == want


@pytest.mark.parametrize("limit", [10, 10**9])
def test_pairs_use_up_their_begin(skewed, limit):
    got = {r["at"]: r["paired"] for r in pair_next(
        skewed, F.col("v") == 1, F.col("v") == 2, F.col("at"), ["k"], ["at"],
        min_hot_rows=limit).collect()}
    pending, want = {}, {}
    for r in sorted(skewed.collect(), key=lambda r: r["at"]):
        if r["v"] == 1:
            pending[r["k"]] = r["at"]
        elif r["v"] == 2 and r["k"] in pending:
            want[r["at"]] = pending.pop(r["k"])
    assert got == want


def test_row_numbers_are_dense_and_in_order(skewed):
    got = number_rows(skewed, [F.desc("at")], "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: -r["at"])] == list(range(900))


def test_top_rows_are_pruned_before_the_shuffle(skewed):
    df = top_per(skewed, ["k"], ["at"], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_roots_with_self_links_and_cycles(spark):
    links = spark.createDataFrame(
        [("s", "b", "a"), ("s", "c", "b"), ("s", "d", "c"), ("s", "a", "a"),
         ("s", "x", "y"), ("s", "y", "x"), ("t", "b", "z")], "log string, child string, parent string")
    got = {(r.log, r.child): r.root for r in roots(links, ["log"], "child", "parent").collect()}
    assert got == {("s", "b"): "a", ("s", "c"): "a", ("s", "d"): "a", ("t", "b"): "z",
                   ("s", "x"): "x", ("s", "y"): "x"}


@pytest.mark.parametrize("max_bits,limit", [(6, 8192), (6, 3), (13, 5)])
def test_banded_self_join_equals_brute_force(spark, max_bits, limit):
    hashes = sorted(set(hash_families(1)))
    df = cluster.with_lanes(spark.createDataFrame([(h,) for h in hashes], "h string"), "h")
    got = [tuple(sorted((r.a_h, r.b_h))) for r in near_pairs(df, None, max_bits, limit).collect()]
    want = {(a, b) for a in hashes for b in hashes if a < b and bits_apart(a, b) <= max_bits}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("limit", [8192, 4])
def test_banded_join_of_two_sides_equals_brute_force(spark, limit):
    hashes = sorted(set(hash_families(2)))
    left, right = hashes[::3], sorted(set(hashes[1::3] + hashes[:4]))
    frames = [cluster.with_lanes(spark.createDataFrame([(h,) for h in hs], "h string"), "h")
              for hs in (left, right)]
    got = [(r.a_h, r.b_h) for r in near_pairs(*frames, 6, limit).collect()]
    want = {(a, b) for a in left for b in right if bits_apart(a, b) <= 6}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("max_bits, limit", [(13, 8192), (13, 3), (12, 8192), (1, 2), (0, 8192)])
def test_lookup_with_one_bit_variants_equals_brute_force(spark, max_bits, limit):
    rng = random.Random(max_bits)
    base = [rng.getrandbits(128) for _ in range(3)]

    def some(n):
        out = set()
        while len(out) < n:
            h = rng.choice(base)
            for b in rng.sample(range(128), rng.choice([0, 1, 2, 6, 12, 13, 14, 15])):
                h ^= 1 << b
            out.add(h & ~(0xFF << 60))       # eight bits never vary
        return sorted(out)

    def frame(hashes):
        return spark.createDataFrame([(f"{h:032x}",) for h in hashes], "h string").select(
            "h", bits.lane("h", 0).alias("hi"), bits.lane("h", 1).alias("lo"))

    mine, known = some(150), some(40)
    got = [(int(r.a_h, 16), int(r.b_h, 16), r.bits) for r in near_known(frame(mine), frame(known), max_bits, limit).collect()]
    assert sorted(got) == sorted((a, b, (a ^ b).bit_count()) for a in mine for b in known if (a ^ b).bit_count() <= max_bits)
    order = bit_order(frame(mine), frame(known))
    assert sorted(order) == list(range(128)) and set(order[-8:]) == set(range(60, 68))
    assert near_known(frame(mine), frame(known).limit(0), max_bits).count() == 0


def test_nearest_known_edges_of_the_threshold(spark):
    def flipped(n):
        return f"{(1 << n) - 1:032x}"
    df = spark.createDataFrame([(flipped(n),) for n in (0, 6, 12, 13, 14, 60)], "h string")
    known = spark.createDataFrame([("0" * 32,), ("f" * 32,)], "h string")
    got = {r.h: r.bits for r in cluster.nearest_known(df, known, "h", 13).collect()}
    assert got == {flipped(0): 0, flipped(6): 6, flipped(12): 12, flipped(13): 13}


def brute_dbscan(rows, max_bits, min_samples, other_group, count_self):
    """rows: (pos, hash, group) in order; labels by first core row, borders to the least label."""
    n = len(rows)

    def near(i, j):
        if i == j:
            return count_self
        if other_group and rows[i][2] == rows[j][2]:
            return False
        return bits_apart(rows[i][1], rows[j][1]) <= max_bits

    nbrs = [[j for j in range(n) if near(i, j)] for i in range(n)]
    core = [len(x) >= min_samples for x in nbrs]
    label, next_label = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] == -1:
            todo, label[i] = [i], next_label
            while todo:
                a = todo.pop()
                for b in nbrs[a]:
                    if core[b] and label[b] == -1:
                        label[b] = next_label
                        todo.append(b)
            next_label += 1
    for i in range(n):
        if not core[i]:
            label[i] = min((label[j] for j in nbrs[i] if core[j]), default=-1)
    return {rows[i][0]: (label[i], core[i]) for i in range(n)}


@pytest.mark.parametrize("other,count_self,dense", [
    (False, True, 64), (False, True, -1), (True, False, 64), (True, False, -1)])
def test_dbscan_equals_brute_force(spark, other, count_self, dense):
    rng = random.Random(5)
    hashes = hash_families(7, families=8, size=6, spread=7)
    hashes += rng.choices(hashes, k=20)
    rows = [(i, h, f"d{rng.randrange(4)}") for i, h in enumerate(hashes)]
    if other:   # one row per (domain, hash), as after the first-ad step
        seen = {}
        for r in rows:
            seen.setdefault(r[1:], r)
        rows = sorted(seen.values())
    want = brute_dbscan(rows, 6, 3, other, count_self)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "pos int, screenshot_hash string, domain string")
    got = cluster.dbscan(df, order_by=["pos"], other_group="domain" if other else None,
                         count_self=count_self, dense_pairs_per_hash=dense)
    assert {r.pos: (r.label, r.is_core) for r in got.collect()} == want
    assert any(v[0] >= 0 and not v[1] for v in want.values()) or other


def test_pruning_and_curation(spark):
    rows = [(0, f"d{i}", f"http://d{i}/a.html", i < 2, i) for i in range(4)]
    rows += [(1, f"d{i}", f"http://d{i}/a.html", i < 1, i) for i in range(3)]      # core 1/3
    rows += [(2, f"d{i}", f"http://d{i}/a.png", True, i) for i in range(3)]        # image
    rows += [(3, "d0", "http://d0/", True, 0), (3, "d1", "http://d1/", True, 1)]   # two domains
    rows += [(4, f"d{i % 3}", "http://x/", True, i) for i in range(6)] + [(-1, "z", "", False, 9)]
    df = spark.createDataFrame(rows, "label long, domain string, ad_url string, is_core boolean, pos int")
    kept = cluster.prune_clusters(df, order_by=["pos"])
    assert sorted((r.label, r.domain, r.pos) for r in kept.collect()) == [
        (0, "d0", 0), (0, "d1", 1), (0, "d2", 2), (0, "d3", 3), (4, "d0", 0), (4, "d1", 1), (4, "d2", 2)]
    excluded = spark.createDataFrame([(4, "error")], "label long, why string")
    members, counts = cluster.filter_clusters(df.where("label >= 0"), excluded, 4)
    assert {r.label for r in members.collect()} == {0}
    assert tuple(counts.first()) == (5, 3, 1, 1)


def test_cluster_lookup_prefers_equal_then_nearest(spark):
    members = spark.createDataFrame([(1, "0" * 32), (1, "0" * 31 + "f"), (2, "f" * 32)],
                                    "label int, screenshot_hash string")
    ads = spark.createDataFrame(
        [("a", "0" * 31 + "f"), ("b", "0" * 29 + "fff"), ("c", "0" * 28 + "1fff"), ("d", "f" * 32)],
        "id string, screenshot_hash string")
    got = {r.id: r.label for r in cluster.match_clusters(ads, members).collect()}
    assert got == {"a": 1, "b": 1, "c": -1, "d": 2}


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = spark.conf.get(cut.SETTING)
    assert cut.checkpoint_folder(spark) == folder
    kept = cut.materialise(spark.range(3))
    assert kept.count() == 3 and all(folder in f for f in kept.inputFiles())


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        cut.checkpoint_folder(Session())


def test_dbscan_keeps_rows_without_hash_as_noise(spark):
    rows = [(i, "0" * 32) for i in range(4)] + [(i, None) for i in range(4, 9)]
    got = cluster.dbscan(spark.createDataFrame(rows, "pos int, screenshot_hash string"),
                         order_by=["pos"], min_samples=3).collect()
    assert sorted((r.pos, r.label, r.is_core) for r in got) == [
        (i, 0, True) if i < 4 else (i, -1, False) for i in range(9)]


def test_bucket_joins_are_not_broadcast(spark, capsys):
    """The buckets hold every hash many times over, which size estimates do not see."""
    rng = random.Random(5)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(40)]
    points = cut.materialise(spark.createDataFrame(rows, "hi long, lo long"))
    near_known(points, points, 13).explain()
    near_pairs(points, None, 6).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


@pytest.mark.parametrize("high", [False, True])
def test_narrow_bands_compare_all_pairs_in_blocks(spark, monkeypatch, high):
    """Sixteen of 64 bits: bands of four bits, of which most pairs share one."""
    rng = random.Random(11)
    points = {rng.getrandbits(64) for _ in range(60)}
    points |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in list(points)[:20]}
    hashes = [f"{x << (64 if high else 0):032x}" for x in points]
    df = cluster.with_lanes(spark.createDataFrame([(h,) for h in hashes], "h string"), "h")
    monkeypatch.setattr(similarity, "_heavy", None)
    pairs = near_pairs(df, None, 16, limit=8, block=13).collect()
    assert all((r.a_hi, r.a_lo) < (r.b_hi, r.b_lo) and bits_apart(r.a_h, r.b_h) == r.bits for r in pairs)
    got = sorted(tuple(sorted((r.a_h, r.b_h))) for r in pairs)
    assert got == sorted((a, b) for a in hashes for b in hashes if a < b and bits_apart(a, b) <= 16)
    assert len(got) >= 20
