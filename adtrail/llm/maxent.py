"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Words get a class by frequency and shape;
inside a class a word's probability is its smoothed share. The class is predicted by a softmax over
hashed features: the word before, the word before that (a skip), the two together, and the classes
of the last three. Weights are trained in rounds: each task takes gradient steps over its share of
the round's training texts, and the rounds' weights are averaged. Scoring runs in numpy batches.

Texts meet their words' counts block by block; only a block's different words travel.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adtrail.plans.cut import materialise

SMOOTH = 0.1
BLOCK_BYTES = 16 << 20
#: Hashed feature rows, words with a class of their own, training rounds, tokens per step.
BUCKETS = 1 << 14
TOP_WORDS = 10
ROUNDS = 2
STEP_TOKENS = 4096
RATE = 0.5
END, UNKNOWN = 0, 1
#: Classes: end of text, unknown, frequent words, and shapes (punctuation x letters x frequency).
CLASSES = 2 + TOP_WORDS + 36
FEATURES = 4
_CHUNK = 256
_WORD = "word"


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case; white space is space and \\t..\\r."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _class(top: list[str]) -> Column:
    """Class of a word that training texts hold ``c`` times."""
    end = F.right(F.col(_WORD), F.lit(1))
    mark = F.when(end.isin(".", "!", "?"), 2).when(end.isin(",", ";", ":"), 1).otherwise(0)
    letters = F.when(F.col(_WORD).rlike("[äöüß]"), 1).when(
        F.col(_WORD).rlike("[èêëçàâîïôùûœæ]"), 2).when(F.col(_WORD).rlike("[ñóíáú¿¡]"), 3).otherwise(0)
    often = F.when(F.col("c") >= 100, 0).when(F.col("c") >= 3, 1).otherwise(2)
    shape = 2 + TOP_WORDS + (mark * 4 + letters) * 3 + often
    own = F.array_position(F.array(*[F.lit(w) for w in top]), F.col(_WORD)) if top else F.lit(0)
    return F.when(F.col("c") == 0, UNKNOWN).when(own > 0, own + 1).otherwise(shape).cast("int")


def _count_words(batches):
    """Arrow batches (block, trains, text) of a partition to (block, word, count in training)."""
    seen: dict[int, Counter] = {}
    for batch in batches:
        for block, trains, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = seen.setdefault(block, Counter())
            if trains:
                own.update(tokens(text))
            else:
                for w in tokens(text):
                    own.setdefault(w, 0)
    for block, own in seen.items():
        names, n = list(own), np.fromiter(own.values(), np.int64, len(own))
        for a in range(0, len(names), 50_000):
            part = pa.array(names[a:a + 50_000], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(part), pa.int64()), part, pa.array(n[a:a + 50_000])],
                names=["block", _WORD, "n"])


def _hash_words(names: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh32_intdigest(w) % BUCKETS for w in names), np.int64, len(names))


def _code_block(docs: pa.Table, known: pa.Table, total: int, different: int, ends: int,
                share: np.ndarray) -> pa.Table:
    """A block's texts as classes and word hashes, with the scores that need no history."""
    names = known.column(_WORD).cast(pa.binary()).to_pylist()
    place = {w: i for i, w in enumerate(names)}
    c = np.append(np.asarray(known.column("c")), ends).astype(np.float64)
    cls = np.append(np.asarray(known.column("cls")), END if ends else UNKNOWN).astype(np.int64)
    bucket = np.append(_hash_words(names), 1)
    base = np.log10((c + SMOOTH) / (total + SMOOTH * (different + 1)))
    inside = np.log10((c + SMOOTH) / share[cls])
    inside[cls == UNKNOWN] = 0.0
    out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "inside", "classes", "words")}
    for text in docs.column("_text").to_pylist():
        own = tokens(text)
        at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        at = np.append(at, len(names))
        out["n_tokens"].append(len(at))
        out["n_known"].append(int((c[at] > 0).sum()))
        out["base"].append(float(base[at].sum()))
        out["inside"].append(float(inside[at].sum()))
        out["classes"].append(cls[at].astype(np.uint8).tobytes())
        out["words"].append(bucket[at].astype(np.uint16).tobytes())
    return pa.table({"_row": docs.column("_row"), "trains": docs.column("trains"), **out})


def _history(classes: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature rows ``[FEATURES, tokens]``; ``first`` marks the first token of each text."""
    start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    place = np.arange(len(first)) - start

    def back(x, k, none):
        y = np.empty(len(x), np.int64)
        y[:k], y[k:] = none, x[:len(x) - k]
        y[place < k] = none
        return y
    w1, w2 = back(words, 1, 2), back(words, 2, 2)
    c1, c2, c3 = (back(classes, k, 255) for k in (1, 2, 3))
    mix = lambda x, salt: ((x * 0x9E3779B1 + salt) ^ (x >> 7)) * 0x85EBCA77 >> 9
    return np.stack([mix(w1, 1), mix(w2, 2), mix(w1 * BUCKETS + w2, 3),
                     mix((c1 * 256 + c2) * 256 + c3, 4)]) % BUCKETS


def _log_softmax(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = np.repeat(bias[None, :], rows.shape[1], axis=0)
    for r in rows:
        z += weights[r]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _flat(batch):
    """Classes, words and first-token marks of a coded batch, piece by piece of bounded size."""
    size = np.asarray(batch.column("n_tokens"))
    a = 0
    while a < len(size):
        b = a + 1
        total = size[a]
        while b < len(size) and total + size[b] <= 16 * STEP_TOKENS:
            total += size[b]
            b += 1
        part = batch.slice(a, b - a)
        classes = np.frombuffer(b"".join(part.column("classes").to_pylist()), np.uint8).astype(np.int64)
        words = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint16).astype(np.int64)
        first = np.zeros(len(classes), bool)
        first[np.concatenate([[0], np.cumsum(size[a:b])[:-1]])] = True
        yield a, b, classes, words, first
        a = b


def _descend(batches, weights: np.ndarray, bias: np.ndarray, rate: float):
    """Gradient steps over a task's texts (AdaGrad, one rate per feature row); yields the change of
    each chunk of rows."""
    w, seen, any_ = weights.copy(), np.zeros(len(weights), np.float32), False
    for batch in batches:
        for _, _, classes, words, first in _flat(batch):
            features = _history(classes, words, first)
            for s in range(0, len(classes), STEP_TOKENS):
                any_ = True
                rows, y = features[:, s:s + STEP_TOKENS], classes[s:s + STEP_TOKENS]
                g = -np.exp(_log_softmax(rows, w, bias))
                g[np.arange(len(y)), y] += 1.0
                for r in rows:
                    order = np.argsort(r, kind="stable")
                    at = r[order]
                    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    total = np.add.reduceat(g[order], cut, axis=0)
                    own = at[cut]
                    seen[own] += (total ** 2).mean(axis=1)
                    w[own] += rate * total / np.sqrt(seen[own] * len(w[0]) + 1.0)[:, None]
    if any_:
        for k in range(0, len(w), _CHUNK):
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([k], pa.int32()),
                "change": pa.array([(w[k:k + _CHUNK] - weights[k:k + _CHUNK]).astype(np.float32).tobytes()],
                                   pa.binary())})


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in pdf["change"])
    return pd.DataFrame({"chunk": pdf["chunk"][:1],
                         "change": [(total / len(pdf)).astype(np.float32).tobytes()]})


def _score(batches, weights: np.ndarray, bias: np.ndarray):
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for a, b, classes, words, first in _flat(batch):
            features = _history(classes, words, first)
            p = np.empty(len(classes))
            for s in range(0, len(classes), STEP_TOKENS):
                y = classes[s:s + STEP_TOKENS]
                p[s:s + STEP_TOKENS] = _log_softmax(features[:, s:s + STEP_TOKENS], weights, bias)[
                    np.arange(len(y)), y]
            out[a:b] = np.add.reduceat(p, np.flatnonzero(first)) / np.log(10)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(5)] + [pa.array(np.asarray(batch.column("inside")) + out)],
            names=["_row", "trains", "n_tokens", "n_known", "base", "score"])


def language_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``, the scores being log10 probabilities of the whole text.

    Texts whose crc32(doc_id as text) mod 10 is 0 are held out, all others train; a NULL id counts as
    the empty text. A NULL or empty text is its end alone. Words that no training text holds count
    as one unknown word. Repeated rows count each; an empty table gives no rows, and further columns
    are ignored whatever their names.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trains = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 != 0
    first = docs.agg(F.sum(F.octet_length(body)).alias("bytes"), F.count_if(trains).alias("ends")).first()
    blocks = max(1, -(-(first["bytes"] or 0) // block_bytes))
    ends = int(first["ends"] or 0)
    kind = docs.schema[doc_id].dataType.simpleString()
    df = docs.select(
        F.struct(F.col(doc_id).alias("i")).alias("_row"), trains.alias("trains"), body.alias("_text"),
        F.pmod(F.xxhash64(F.col(doc_id), body), F.lit(blocks)).alias("block"),
    ).repartition(blocks, "block")
    found = materialise(df.select("block", "trains", "_text").mapInArrow(
        _count_words, f"block bigint, {_WORD} string, n bigint"))
    counts = materialise(found.groupBy(_WORD).agg(F.sum("n").alias("c")))
    sums = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, different = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0)
    # bounded: a few words, and one sum per class
    top = [r[_WORD] for r in counts.where("c > 0").orderBy(F.col("c").desc(), _WORD).limit(TOP_WORDS).collect()]
    lexicon = counts.withColumn("cls", _class(top))
    share = np.full(CLASSES, SMOOTH)
    for r in lexicon.where("c > 0").groupBy("cls").agg(F.sum(F.col("c") + SMOOTH).alias("m")).collect():
        share[r["cls"]] = r["m"]
    share[END] = ends + SMOOTH if ends else SMOOTH
    bias = np.log(share / share.sum()).astype(np.float32)
    known = found.join(lexicon.hint("merge"), _WORD).select("block", _WORD, "c", "cls")
    coded = materialise(df.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        lambda a, b: _code_block(a, b, total, different, ends, share),
        f"_row struct<i:{kind}>, trains boolean, n_tokens bigint, n_known bigint, base double, "
        "inside double, classes binary, words binary"))
    weights = np.zeros((BUCKETS, CLASSES), np.float32)
    columns = ["_row", "trains", "n_tokens", "n_known", "base", "inside", "classes", "words"]
    for k in range(rounds):
        part = coded.where(F.col("trains") & (F.pmod(F.xxhash64("classes"), F.lit(rounds)) == k))
        changes = part.select(*columns).mapInArrow(
            partial(_descend, weights=weights, bias=bias, rate=rate), "chunk int, change binary")
        # BUCKETS x CLASSES numbers, however large the input
        for r in changes.groupBy("chunk").applyInPandas(_mean, "chunk int, change binary").collect():
            weights[r["chunk"]:r["chunk"] + _CHUNK] += np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES)
    out = coded.select(*columns).mapInArrow(
        partial(_score, weights=weights, bias=bias),
        f"_row struct<i:{kind}>, trains boolean, n_tokens bigint, n_known bigint, base double, score double")
    return out.select(
        F.col("_row.i").alias(doc_id), (~F.col("trains")).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
