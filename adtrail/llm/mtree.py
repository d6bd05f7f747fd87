"""Exact top-k by inner product: M-trees searched best first.

With one more coordinate, sqrt(M^2 - |x|^2), all vectors of a block have the same length, and the
largest inner product is the smallest distance. Each block of vectors becomes an M-tree of pages:
a page holds entries with their distance to the page's parent, and inner entries a covering radius.
Queries meet the blocks in groups; a search takes the page with the smallest possible distance,
and stored distances rule entries out before theirs is computed. Scores are exact integers.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from adtrail.plans.cut import materialise

SCALE = 256
TOP = 5
EVERY = 50
#: Vectors per tree, queries per group, entries per page.
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
PAGE = 128
#: Slack for bounds in floating point, relative to the length of the vectors.
SLACK = 1e-9


class MTree:
    """Paged nodes over the rows of ``x``. ``pages[p]`` is (is_leaf, entries, to_parent, radius):
    rows and distances to the routing row, and for inner pages child pages and radii."""

    def __init__(self, x: np.ndarray, page: int = PAGE):
        self.x = x
        self.pages: list[tuple] = []
        self.root = self._build(np.arange(len(x)), None, page)

    def _distance(self, rows: np.ndarray, row: int) -> np.ndarray:
        return np.sqrt(((self.x[rows] - self.x[row]) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, parent: int | None, page: int) -> int:
        up = np.zeros(len(rows)) if parent is None else self._distance(rows, parent)
        if len(rows) <= page:
            self.pages.append((True, rows, up, None, None))
            return len(self.pages) - 1
        # routing rows far from each other, chosen one after the other
        routes, near = [0], self._distance(rows, rows[0])
        owner = np.zeros(len(rows), np.int64)
        while len(routes) < page and near.max() > 0:
            far = int(near.argmax())
            d = self._distance(rows, rows[far])
            owner[d < near] = len(routes)
            near = np.minimum(near, d)
            routes.append(far)
        if len(routes) == 1:  # all rows alike: pages of equal rows
            parts = np.array_split(np.arange(len(rows)), -(-len(rows) // page))
            if len(parts) > page:
                parts = np.array_split(np.arange(len(rows)), page)
        else:
            parts = [np.flatnonzero(owner == k) for k in range(len(routes))]
        heads = [int(rows[p[0]]) if len(routes) == 1 else int(rows[routes[k]])
                 for k, p in enumerate(parts)]
        children, radius, to_parent = [], [], []
        for head, part in zip(heads, parts):
            children.append(self._build(rows[part], head, page))
            radius.append(float(self._distance(rows[part], head).max()))
            to_parent.append(float(self._distance(np.array([head]), parent)[0]) if parent is not None else 0.0)
        self.pages.append((False, np.array(heads), np.array(to_parent), np.array(radius),
                           np.array(children)))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, k: int, score, slack: float):
        """The ``k`` best ``(score, tie)`` by ``score(rows)``, which gives exact sort keys, larger
        being better. Best first: a page waits with the least distance that anything below it can
        have."""
        best: list[tuple] = []  # heap of the k best keys, worst first
        queue = [(0.0, self.root, 0.0, True)]
        bound = np.inf
        while queue:
            least, number, parent, is_root = heapq.heappop(queue)
            if least > bound + slack:
                break
            leaf, rows, up, radius, children = self.pages[number]
            if is_root:
                live = np.ones(len(rows), bool)
            else:
                # triangle inequality on the stored distance to the parent, nothing computed yet
                reach = 0.0 if leaf else radius
                live = np.abs(parent - up) - reach <= bound + slack
            rows = rows[live]
            if len(rows) == 0:
                continue
            d = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
            if leaf:
                near = d <= bound + slack
                rows, d = rows[near], d[near]
                for key, dist in zip(score(rows), d.tolist()):
                    if key is None:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (key, dist))
                    elif key > best[0][0]:
                        heapq.heapreplace(best, (key, dist))
                if len(best) == k:
                    bound = max(x[1] for x in best)
            else:
                low = np.maximum(d - radius[live], 0.0)
                for a, child, dist in zip(low.tolist(), children[live].tolist(), d.tolist()):
                    if a <= bound + slack:
                        heapq.heappush(queue, (a, child, dist, False))
        return sorted((key for key, _ in best), reverse=True)


def _search_block(pdf: pd.DataFrame, top: int) -> pd.DataFrame:
    """One block of vectors and one group of queries to the block's best rows per query."""
    is_query = pdf["is_query"].to_numpy()
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    ids = pdf["vec_id"].to_numpy(np.int64)[~is_query]
    if len(ids) and is_query.any():
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        exact = np.stack(pdf["v"][~is_query].to_list()).astype(np.int64)[order]
        x = exact.astype(np.float64)
        length = (x ** 2).sum(axis=1)
        big = float(length.max())
        tree = MTree(np.column_stack([x, np.sqrt(np.maximum(big - length, 0.0))]))
        own = pdf[is_query]
        for query, v in zip(own["vec_id"].to_numpy(np.int64), own["v"]):
            v = np.asarray(v, np.int64)

            def keys(rows, v=v, query=query):
                return [(int(s), -int(i)) if i != query else None
                        for s, i in zip(exact[rows] @ v, ids[rows])]
            q = np.append(v.astype(np.float64), 0.0)
            scale = 1.0 + np.sqrt(big) + np.sqrt((q ** 2).sum())
            for score, minus in tree.search(q, top, keys, SLACK * scale):
                out["query_id"].append(int(query))
                out["vec_id"].append(-minus)
                out["score"].append(score)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine


def top_inner_products(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                       queries=lambda i: i % EVERY == 0, top: int = TOP,
                       block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query the ``top`` rows with the largest inner product
    of ``floor(256 * x)``, ties to the smaller id, the query's own id left out.

    Rows with a NULL id, a NULL vector, or NULL or non-finite components take no part. Vectors are
    compared with those of their own length only; an empty vector scores 0. A repeated id is one
    candidate per row and one query per row's id. The sums must fit 64 bits. An empty table gives no
    rows, and further columns are ignored whatever their names.
    """
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & _usable(F.col("x"))).select(
        "vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long")).alias("v"))
    rows = materialise(rows.withColumn("dim", F.size("v")))
    asked = rows.where(queries(F.col("vec_id"))).dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-rows.count() // block_rows))
    groups = max(1, -(-asked.count() // query_rows))
    number = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("dim", number(blocks, 1).alias("block"), spread(groups).alias("part"),
                       "vec_id", "v", F.lit(False).alias("is_query"))
    ask = asked.select("dim", spread(blocks).alias("block"), number(groups, 2).alias("part"),
                       "vec_id", "v", F.lit(True).alias("is_query"))
    found = data.unionByName(ask).groupBy("dim", "block", "part").applyInPandas(
        partial(_search_block, top=top), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
