"""Near-duplicates by ProbMinHash signatures of weighted word shingles.

Every shingle of five words weighs as often as it occurs. Each one is a Poisson process whose rate
is its weight; an arrival falls on a random register, and a register keeps the shingle that arrives
first. A process ends when its next arrival is later than every register. Two registers agree with
the probability Jaccard similarity of the texts. Bands of registers give candidate buckets; every
link is verified on the whole texts.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adtrail.llm.text import word_hashes
from adtrail.plans.components import components
from adtrail.plans.cut import materialise

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at a similarity of 0.8 shares no band with a probability of (1 - 0.8**5)**28 = 1.5e-5.
BANDS = 28
ROWS = 5
#: Rounds in which members of a bucket's largest group are the pivots.
PROBES = 2
#: A similarity is a sum of fractions; one at the bound itself counts.
ROUNDING = 1e-9
#: Words whose arrivals are computed together in one task.
TASK_WORDS = 1 << 17

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle, no words give none."""
    w = words.view(np.uint64)
    if len(w) == 0:
        return w
    size = min(size, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix((out ^ w[i:len(w) - size + 1 + i]) + _GOLD)
    return out


def weighted(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(shingles(words, size), return_counts=True)
    return keys, counts.astype(np.float64)


def probability_jaccard(a, b) -> float:
    """Exact similarity of two ``(keys, weights)``: the sum over common keys d of
    1 / sum_e max(x_e / x_d, y_e / y_d), from prefix sums over the keys sorted by x / y."""
    (ka, xa), (kb, yb) = a, b
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if len(i) == 0:
        return 0.0
    x, y = xa[i], yb[j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    from_x = np.cumsum(x[::-1])[::-1] + (xa.sum() - x.sum())
    from_y = np.concatenate([[0.0], np.cumsum(y)[:-1]]) + (yb.sum() - y.sum())
    return float((1.0 / (from_x / x + from_y / y)).sum())


def signatures(doc: np.ndarray, keys: np.ndarray, weights: np.ndarray, n_docs: int,
               registers: int) -> np.ndarray:
    """ProbMinHash registers ``[n_docs, registers]`` of the weighted keys; ``doc`` says whose they
    are. Every text has at least one key."""
    time = np.full(n_docs * registers, np.inf)
    first = np.zeros(n_docs * registers, np.uint64)
    at, step, drawn = np.zeros(len(keys)), 1, 0
    while len(keys):
        number = (np.arange(drawn, drawn + step, dtype=np.uint64) + np.uint64(1)) * _GOLD
        r = _mix(keys[:, None] + number[None, :])
        unit = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        arrival = at[:, None] + np.cumsum(-np.log(unit), axis=1) / weights[:, None]
        slot = doc[:, None] * registers + (_mix(r + _GOLD) % np.uint64(registers)).astype(np.int64)
        wins = arrival < time[slot]
        s, t = slot[wins], arrival[wins]
        k = np.broadcast_to(keys[:, None], wins.shape)[wins]
        np.minimum.at(time, s, t)
        best = time[s] == t
        first[s[best]] = k[best]
        at = arrival[:, -1]
        # end of the processes that have passed every register of their text
        docs = np.unique(doc)
        latest = np.zeros(n_docs)
        latest[docs] = time.reshape(n_docs, registers)[docs].max(axis=1)
        live = at < latest[doc]
        doc, keys, weights, at = doc[live], keys[live], weights[live], at[live]
        drawn, step = drawn + step, min(2 * drawn + 1, 256)
    return first.reshape(n_docs, registers)


def _bands(batches, size: int, bands: int, rows: int):
    """Arrow batches (doc_id, key, words) to (doc_id, key, bands)."""
    for batch in batches:
        lists = batch.column(2)
        offsets = np.asarray(lists.offsets)
        flat = np.asarray(lists.values)
        out = [np.empty(0, np.uint64)]
        count = np.zeros(len(lists), np.int64)
        with np.errstate(over="ignore"):
            a = 0
            while a < len(lists):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + TASK_WORDS, "right")) - 1)
                b = min(b, len(lists))
                own = [(i, *weighted(flat[offsets[i]:offsets[i + 1]], size))
                       for i in range(a, b) if offsets[i + 1] > offsets[i]]
                if own:
                    doc = np.repeat(np.arange(len(own)), [len(k) for _, k, _ in own])
                    sig = signatures(doc, np.concatenate([k for _, k, _ in own]),
                                     np.concatenate([w for _, _, w in own]), len(own), bands * rows)
                    sig = sig.reshape(len(own), bands, rows)
                    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
                    for r in range(rows):
                        h = _mix((h ^ sig[:, :, r]) + _GOLD)
                    out.append(h.reshape(-1))
                    count[[i for i, _, _ in own]] = bands
                a = b
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).view(np.int64)))],
            names=["doc_id", "key", "bands"])


def _verify(batches, size: int, similarity: float):
    """Arrow batches (a, b, words_a, words_b) to the linked (a, b)."""
    last = (None, None)
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        sides = []
        for c in (2, 3):
            lists = batch.column(c)
            sides.append((np.asarray(lists.offsets), np.asarray(lists.values)))
        hit = np.zeros(len(a), bool)
        with np.errstate(over="ignore"):
            for i in range(len(a)):
                if last[0] != a[i]:
                    o, v = sides[0]
                    last = (a[i], weighted(v[o[i]:o[i + 1]], size))
                o, v = sides[1]
                hit[i] = probability_jaccard(last[1], weighted(v[o[i]:o[i + 1]], size)) > similarity - ROUNDING
        yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], names=["a", "b"])


def _shares(batches, size: int):
    """Arrow batches (id, words) to (id, key, share of the text's weight)."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        lists = batch.column(1)
        offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        held, n = [], 0
        for i in range(len(ids)):
            with np.errstate(over="ignore"):
                keys, weights = weighted(flat[offsets[i]:offsets[i + 1]], size)
            held.append((np.full(len(keys), ids[i]), keys.view(np.int64), weights / weights.sum()))
            n += len(keys)
            if n >= TASK_WORDS or i == len(ids) - 1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*held)], names=["id", "key", "share"])
                held, n = [], 0


def _reach(stored: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``(id, reach)``: the mean of two texts' reach bounds their similarity from above.

    Let u and v be the shares of shingles that no other of the texts holds. In the sum that defines
    the similarity the denominator of a common d, of shares p and q, is at least 1/p + v/q and at
    least 1/q + u/p, so its mean is at least ((1+u)/p + (1+v)/q)/2, and the term at most
    (p/(1+u) + q/(1+v))/2. Common shares sum to 1-u and 1-v at most, so a text reaches (1-u)/(1+u).
    """
    rows = stored.join(ids, "id").select("id", "w").mapInArrow(
        partial(_shares, size=size), "id bigint, key bigint, share double")
    own = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("share").alias("share")).where("n = 1")
    u = F.coalesce("u", F.lit(0.0))
    return materialise(ids.join(own.groupBy("id").agg(F.sum("share").alias("u")), "id", "left").select(
        "id", ((1 - u) / (1 + u)).alias("reach")))


def _pairs(members: DataFrame, labels: DataFrame | None, turn: int, similarity: float):
    """Pairs to verify in this round, and the members left for later ones.

    A pivot is compared with all members of its bucket that are not in its group; then it is
    settled there and leaves the bucket. At first (no labels) the pivot is the smallest member.
    Later rounds look at buckets that still hold several groups, and only at pairs whose ``reach``
    allows a link: for ``PROBES`` rounds four times as many pivots each time come from the largest
    group, those of the highest reach first, so that members outside it, which get fewer with each
    link, are compared with few; then those that are left are the pivots themselves.
    """
    if labels is None:
        low = members.groupBy("bucket").agg(F.min("id").alias("a"))
        both = members.join(low, "bucket").where("id != a")
        return both.select("a", F.col("id").alias("b")), both.select("bucket", "id")
    now = members.join(labels, "id")
    groups = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy("bucket").agg(
        F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("groups"))
    now = materialise(now.join(mixed.where("groups > 1").select("bucket", "main"), "bucket"))
    # one order for all buckets of a round: buckets that overlap then share pivots
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(
        F.col("reach").desc(), F.xxhash64("id", F.lit(turn)), "id"))
    probing = turn <= PROBES
    chosen = now.where("label = main" if probing else "label != main").withColumn("_rank", rank).where(
        F.col("_rank") <= 4 ** turn).select(
        "bucket", F.col("id").alias("a"), F.col("label").alias("la"), F.col("reach").alias("ra"))
    both = now.join(chosen, "bucket").where(
        (F.col("label") != F.col("la")) & (F.col("reach") + F.col("ra") > 2 * similarity - ROUNDING))
    # between two pivots once is enough
    both = both.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    rest = now.select("bucket", "id", "reach").join(
        chosen.select("bucket", F.col("a").alias("id")), ["bucket", "id"], "left_anti")
    return both, rest


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def near(labels: DataFrame) -> DataFrame:
        side = labels.select(F.col("id").alias("b"), "label")
        return edges.join(side, "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
    return components(nodes, near)


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several groups."""
    several = members.join(labels, "id").groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    return members.join(several, "bucket")


def _classes(docs, doc_id, text, size, similarity, bands, rows):
    """``copies(doc_id, key)`` per input row, ``nodes(key, id, copy_id)`` per different text and
    ``labels(id, label)`` of the texts that share a bucket with another."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.md5(body).alias("key"), body.alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    sketch = materialise(slim.select("doc_id", "key", word_hashes(F.col("text")).alias("w")).mapInArrow(
        partial(_bands, size=size, bands=bands, rows=rows),
        f"doc_id {kind}, key string, bands array<bigint>"))
    nodes = materialise(sketch.groupBy("key").agg(
        F.min("doc_id").alias("copy_id"), F.any_value("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id()))
    rows_ = nodes.select("id", F.explode("bands").alias("bucket"))
    full = rows_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = materialise(rows_.join(full, "bucket"))
    ids = materialise(members.select("id").distinct())
    # one text per node that has candidates, as word hashes
    named = nodes.select("key", "id", "copy_id").join(ids, "id")
    texts = slim.join(named.select("key", "id", F.col("copy_id").alias("_c")), "key").where(
        F.col("doc_id").eqNullSafe(F.col("_c")))
    stored = materialise(texts.groupBy("id").agg(F.any_value("text").alias("text"))
                         .select("id", word_hashes(F.col("text")).alias("w")))
    wa = stored.select(F.col("id").alias("a"), F.col("w").alias("wa"))
    wb = stored.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    labels, edges, done, turn = None, None, None, 0
    while True:
        pairs, members = _pairs(members, labels, turn, similarity)
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs, members = materialise(pairs), materialise(members)
        done = pairs if done is None else materialise(done.unionByName(pairs))
        new = materialise(pairs.join(wb, "b").join(wa, "a").select("a", "b", "wa", "wb").mapInArrow(
            partial(_verify, size=size, similarity=similarity), "a bigint, b bigint"))
        both = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = materialise(both if edges is None else edges.unionByName(both))
        labels = _components(ids, edges)
        if turn == 0:
            left = materialise(_mixed(members, labels).select("bucket", "id"))
            members = left.join(_reach(stored, left.select("id").distinct(), size), "id")
        top = members.groupBy("bucket").agg(F.max("reach").alias("top"))
        members = materialise(members.join(top, "bucket").where(
            F.col("reach") + F.col("top") > 2 * similarity - ROUNDING).select("bucket", "id", "reach"))
        if _mixed(members, labels).isEmpty():
            return sketch.select("doc_id", "key"), nodes.select("key", "id", "copy_id"), labels
        turn += 1


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``copy_id`` (smallest id with the same text) and
    ``group_id`` (smallest id of the texts connected by links of at least ``similarity``).

    Equal texts are copies, NULL counting as empty. Texts shorter than a shingle are one shingle;
    texts without words are linked to none but their copies. Repeated rows and ids keep their rows;
    NULL ids are passed over when the smallest is taken. An empty table gives no rows, and further
    columns are ignored whatever their names.
    """
    copies, nodes, labels = _classes(docs, doc_id, text, size, similarity, bands, rows)
    named = nodes.join(labels, "id", "left").select(
        "key", "copy_id", F.coalesce("label", "id").alias("label"))
    lowest = named.groupBy("label").agg(F.min("copy_id").alias("group_id"))
    groups = materialise(named.join(lowest, "label").select("key", "copy_id", "group_id"))
    return copies.join(groups, "key").select(F.col("doc_id").alias(doc_id), "copy_id", "group_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         **options) -> DataFrame:
    """One row of each group stays, with all its columns: the text of the smallest id; of equal
    rows one. Texts whose ids are all NULL form groups like any other, with ties broken by text.
    Otherwise as ``near_duplicates``."""
    size, similarity = options.get("size", SHINGLE), options.get("similarity", SIMILARITY)
    copies, nodes, labels = _classes(docs, doc_id, text, size, similarity,
                                     options.get("bands", BANDS), options.get("rows", ROWS))
    named = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = named.groupBy("label").agg(F.min(F.struct(
        F.col("copy_id").isNull().alias("z"), F.col("copy_id").alias("c"), F.col("key").alias("k")))
        .alias("f")).select(F.col("f.c").alias("_c"), F.col("f.k").alias("_k"))
    same = copies.select(F.col("doc_id").alias("_c"), F.col("key").alias("_k")).groupBy("_c", "_k").agg(
        F.count(F.lit(1)).alias("_n"))
    keep = materialise(first.join(
        same.select(F.col("_c").alias("_c2"), F.col("_k").alias("_k2"), "_n"),
        F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_k") == F.col("_k2"))).select("_c", "_k", "_n"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows_ = docs.select(F.struct("*").alias("_row"), F.md5(body).alias("_k1"))
    kept = rows_.join(keep, (F.col("_k1") == F.col("_k"))
                      & F.col("_row")[doc_id].eqNullSafe(F.col("_c")))
    once = kept.where("_n = 1").select("_row.*")
    more = kept.where("_n > 1").dropDuplicates(["_k"]).select("_row.*")
    return once.unionByName(more) if keep.where("_n > 1").limit(1).count() else once
