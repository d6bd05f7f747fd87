import math

import numpy as np

from adtrail.llm.mtree import top_inner_products

SCHEMA = "vec_id long, embedding array<float>, v string, block int, part int, dim int"


def brute(rows, top=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:top])]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 3])]) for i in range(900)]
    rows += [(i, [0.5] * 8) for i in range(900, 1100)]  # ties
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8),
             (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2250, [1.0, -2.0]), (2300, []), (None, [1.0] * 8),
             (2350, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    for block_rows, query_rows in ((8192, 512), (100, 7)):
        got = top_inner_products(df, block_rows=block_rows, query_rows=query_rows)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_few_and_no_rows(spark):
    few = [(0, [1.0, 1.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in few], SCHEMA)
    assert [tuple(r) for r in top_inner_products(df).collect()] == brute(few)
    assert top_inner_products(df.limit(0)).count() == 0
