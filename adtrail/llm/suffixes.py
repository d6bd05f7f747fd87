"""Repeated passages found by a distributed merge sort of suffixes with common prefixes known.

Sorting the suffix at every byte would move 200 bytes for each byte of the corpus. Instead every
200-byte string names one of its inner positions, its anchor: the 64-byte string inside it with the
smallest hash, the leftmost of equals. Equal strings have equal anchors at equal places, so only
suffixes at anchors whose 64 bytes occur twice or more can matter. An anchor answers for all
strings that name it: its key is the text to the right as far as they reach, then the text to the
left, backwards. Tasks sort their keys and front-code them into runs, runs go to range partitions
by the anchor's hash, and loser trees merge them: each head carries its common prefix with the last
key put out, so no known prefix is compared again. Equal keys come out side by side; where an
anchor has several keys, their strings are compared offset by offset.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from adtrail.plans.cut import materialise

LENGTH = 200
GRAM = 64
#: Bytes hashed at once in one task.
TASK_BYTES = 1 << 20
#: Anchors per merge partition, were they all shared.
TASK_ANCHORS = 20_000
#: Bytes of keys that one task sorts at once.
RUN_BYTES = 16 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 22) - 1)
_ID = "_id"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position, by doubling."""
    h = _mix((data.astype(np.uint64) + np.uint64(1)) * _GOLD)
    n = 1
    while n < gram:
        h = _mix(h[:-n] * _GOLD + h[n:]) if len(h) > n else h[:0]
        n *= 2
    return h


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values."""
    if len(x) < n:
        return x[:0]
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:len(x) - (n - k)], x[n - k:]) if n > k else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of the texts that end at ``ends`` in ``data``: hash, position, and the first and
    last start of the strings that name it."""
    hashes = _gram_hashes(data, gram)
    packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    place = (_window_min(packed, length - gram + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - starts - length + 1, 0)
    s = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(
        np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    if len(s) == 0:
        return hashes[:0], s, s, s
    p = place[s]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(s)]]) - 1
    return hashes[p[new]], p[new], s[new], s[last]


def _find_anchors(batches, length: int, gram: int, task_bytes: int):
    """Arrow batches (id, text) to one row per anchor."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        col = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        out = []
        a = 0
        with np.errstate(over="ignore"):
            while a < len(col):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + task_bytes, "right")) - 1)
                # a longer text is cut into pieces that overlap by one string less a byte
                for lo in range(int(offsets[a]), max(int(offsets[b]), int(offsets[a]) + 1), task_bytes):
                    single = b == a + 1
                    hi = min(int(offsets[b]), lo + task_bytes + length - 1) if single else int(offsets[b])
                    ends = np.array([hi - lo]) if single else offsets[a + 1:b + 1] - lo
                    h, p, s, e = anchors(data[lo:hi], ends, length, gram)
                    doc = np.searchsorted(offsets[a + 1:b + 1], p + lo, "right") + a
                    out.append((ids[doc], h.view(np.int64), p + lo - offsets[doc], p - s, p - e))
                    if not single:
                        break
                a = b
        if out:
            i, h, p, s, e = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i), pa.array(h), pa.array(p), pa.array(s.astype(np.int16)),
                 pa.array(e.astype(np.int16))], names=[_ID, "h", "at", "left", "right"])


def _front_code(entries: list[tuple[bytes, list]]) -> bytes:
    """Sorted ``(key, [(id, at)])`` as common prefix lengths, tails and references."""
    shared, tails, last = [], [], b""
    for key, _ in entries:
        n = common_prefix(last, key, 0)
        shared.append(n)
        tails.append(key[n:])
        last = key
    refs = [r for _, rs in entries for r in rs]
    return b"".join([
        np.array([len(entries), len(refs)], np.int64).tobytes(),
        np.array(shared, np.int32).tobytes(), np.array([len(t) for t in tails], np.int32).tobytes(),
        np.array([len(rs) for _, rs in entries], np.int64).tobytes(),
        np.array(refs, np.int64).reshape(-1, 2).tobytes(), b"".join(tails)])


def _decode(run: bytes) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(common prefix with the key before, tail, references), in order."""
    n, m = np.frombuffer(run, np.int64, 2)
    shared = np.frombuffer(run, np.int32, n, 16)
    tails = np.frombuffer(run, np.int32, n, 16 + 4 * n)
    counts = np.frombuffer(run, np.int64, n, 16 + 8 * n)
    refs = np.frombuffer(run, np.int64, 2 * m, 16 + 16 * n).reshape(-1, 2)
    at, r = int(16 + 16 * n + 16 * m), 0
    for k, t, c in zip(shared.tolist(), tails.tolist(), counts.tolist()):
        yield k, run[at:at + t], refs[r:r + c]
        at, r = at + t, r + c


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator]) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """Sorted runs to one sequence of (key, common prefix with the key before, references)."""
    k = len(runs)
    keys: list[bytes | None] = [b""] * k
    known, refs = [0] * k, [None] * k

    def advance(i):
        step = next(runs[i], None)
        if step is None:
            keys[i] = None
        else:
            known[i], refs[i] = step[0], step[2]
            keys[i] = keys[i][:step[0]] + step[1]

    def play(a, b):
        """Winner and loser; both heads know their common prefix with the last winner."""
        if keys[b] is None or (keys[a] is not None and known[a] > known[b]):
            return a, b
        if keys[a] is None or known[b] > known[a]:
            return b, a
        x, y = keys[a], keys[b]
        n = common_prefix(x, y, known[a])
        if x[n:n + 1] <= y[n:n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for i in range(k):
        advance(i)
        known[i] = 0
    losers = [0] * k

    def build(node):
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while keys[winner] is not None:
        yield keys[winner], known[winner], refs[winner]
        i = winner
        advance(i)
        node = (i + k) // 2
        while node:
            i, losers[node] = play(i, losers[node])
            node //= 2
        winner = i


def _make_runs(batches, parts: int, length: int):
    """Arrow batches (id, text, [(h, at, left, right)]) to front-coded runs, one per partition each
    time that the keys at hand reach ``RUN_BYTES``."""
    groups: dict[int, dict[bytes, list]] = {}
    held = 0

    def runs():
        for n, keys in groups.items():
            yield pa.RecordBatch.from_pydict({
                "part": [n], "run": [zlib.compress(_front_code(sorted(keys.items())), 1)]})
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        h, at, left, right = (np.asarray(flat.field(c)) for c in ("h", "at", "left", "right"))
        part = ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        for i in range(batch.num_rows):
            doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes()
            for j in range(offsets[i], offsets[i + 1]):
                p = int(at[j])
                back = text[p - int(left[j]):p][::-1]
                key = b"".join([int(h[j]).to_bytes(8, "big", signed=True),
                                text[p:p - int(right[j]) + length], b"\xff", back])
                groups.setdefault(int(part[j]), {}).setdefault(key, []).append((doc, p))
                held += len(key)
            if held > RUN_BYTES:
                yield from runs()
                groups, held = {}, 0
    yield from runs()


def _settle(group: list[tuple[bytes, list]], length: int, out: list) -> None:
    """Strings of one anchor hash: adds (id, from, to) of the bytes that repeat."""
    sides = []
    for key, refs in group:
        cut = key.index(b"\xff", 8)
        sides.append((key[8:cut], key[cut + 1:], np.concatenate(refs)))
    if len(sides) == 1:
        right, left, refs = sides[0]
        if len(refs) > 1:
            out.append((refs[:, 0], refs[:, 1] - len(left), refs[:, 1] + len(right)))
        return
    first = min(length - len(r) for r, _, _ in sides)
    last = max(len(x) for _, x, _ in sides)
    found = [np.zeros(last - first + 2, bool) for _ in sides]
    for d in range(first, last + 1):
        same: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (right, left, _) in enumerate(sides):
            if length - len(right) <= d <= len(left):
                same.setdefault((right[:length - d], left[:d]), []).append(i)
        for own in same.values():
            if len(own) > 1 or len(sides[own[0]][2]) > 1:
                for i in own:
                    found[i][d - first] = True
    for (_, _, refs), hit in zip(sides, found):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8)])))
        for a, b in edge.reshape(-1, 2) + first:  # distances a .. b-1
            out.append((refs[:, 0], refs[:, 1] - (b - 1), refs[:, 1] - a + length))


def _merge_part(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    out: list = []
    group: list[tuple[bytes, list]] = []
    for key, shared, refs in merge([_decode(zlib.decompress(r)) for r in pdf["run"]]):
        if shared < 8 and group:
            _settle(group, length, out)
            group = []
        if group and shared == len(key) == len(group[-1][0]):
            group[-1][1].append(refs)
        else:
            group.append((key, [refs]))
    if group:
        _settle(group, length, out)
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
    return pd.DataFrame(dict(zip((_ID, "a", "b"), cols)))


def _spans(df: DataFrame, length: int, gram: int) -> DataFrame:
    """``df(_id, _text)`` to ``(_id, spans)``: byte ranges of repeated strings, not yet united."""
    found = materialise(df.where(F.octet_length("_text") >= length).mapInArrow(
        partial(_find_anchors, length=length, gram=gram, task_bytes=TASK_BYTES),
        f"{_ID} bigint, h bigint, at bigint, left smallint, right smallint"))
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = found.join(twice, "h")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, -(-found.count() // TASK_ANCHORS))
    per_doc = shared.groupBy(_ID).agg(F.collect_list(F.struct("h", "at", "left", "right")).alias("_at"))
    runs = df.join(per_doc, _ID).select(_ID, "_text", "_at").mapInArrow(
        partial(_make_runs, parts=parts, length=length), "part bigint, run binary")
    ranges = runs.groupBy("part").applyInPandas(
        partial(_merge_part, length=length), f"{_ID} bigint, a bigint, b bigint")
    return materialise(ranges.groupBy(_ID).agg(F.collect_set(F.struct("a", "b")).alias("_spans")))


def _cut(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of a text, and the maximal removed runs."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    keep, at = [], 0
    for a, b in runs:
        keep.append(text[at:a])
        at = b
    return b"".join([*keep, text[at:]]), runs


def _apply(batches, digest: bool):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        rows = []
        for t, spans in zip(texts.to_pylist(), batch.column(2).to_pylist()):
            kept, runs = _cut(t, [(x["a"], x["b"]) for x in spans or ()])
            rows.append((len(t), sum(b - a for a, b in runs), len(runs),
                         hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "ignore")))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols],
                                         names=["_row", "n_bytes", "n_removed", "n_spans", "kept"])


def _joined(docs: DataFrame, payload, doc_id: str, text: str, length: int, gram: int) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.select(payload.alias("_row"), body.alias("_text"),
                     F.xxhash64(F.col(doc_id), body).alias(_ID))
    spans = _spans(df.select(_ID, "_text"), length, gram)
    return df.join(spans, _ID, "left").select("_row", "_text", "_spans")


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in
    the same text or another. NULL and empty texts have no bytes; texts shorter than ``length``
    lose none; repeated rows repeat each other; ids may be NULL; an empty table gives no rows, and
    further columns are ignored whatever their names.
    """
    df = _joined(docs, F.struct(F.col(doc_id).alias("i")), doc_id, text, length, gram)
    kind = docs.schema[doc_id].dataType.simpleString()
    out = df.mapInArrow(partial(_apply, digest=True),
                        f"_row struct<i:{kind}>, n_bytes bigint, n_removed bigint, n_spans bigint, kept string")
    return out.select(F.col("_row.i").alias(doc_id), "n_bytes", "n_removed", "n_spans",
                      F.col("kept").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   n_chars: str = "n_chars", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` with repeated bytes cut out of the text; ``n_chars`` follows. A
    character of which only a part stays is dropped; a NULL text stays NULL. Otherwise as
    ``repeat_digests``."""
    rest = [c for c in docs.columns if c != text]
    df = _joined(docs, F.struct(*rest, F.col(text).isNull().alias("_null")), doc_id, text, length, gram)
    out = df.mapInArrow(
        partial(_apply, digest=False),
        StructType([df.schema["_row"], *[StructField(c, LongType()) for c in (
            "n_bytes", "n_removed", "n_spans")], StructField("kept", StringType())]))
    new = F.when(~F.col("_row._null"), F.col("kept"))
    given = {text: new, n_chars: F.when(F.col("n_removed") > 0, F.length("kept").cast("long"))}
    return out.select(*[
        (given[c] if c == text else F.coalesce(given[c], F.col("_row")[c]) if c == n_chars
         else F.col("_row")[c]).alias(c) for c in docs.columns])
