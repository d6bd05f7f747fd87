"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units that no piece crosses: a run of word-start marks with the characters up to
the next mark, and line ends. Each different unit is encoded once: its substrings up to the longest
piece are exploded, joined to the piece table, grouped again by unit, and folded with Spark's
higher-order functions. A unigram model folds Viterbi: the best score up to each position. For a
BPE model the best-scoring path is not what the model encodes, so the fold merges the best edge
between two neighbouring symbols until none is left, which is the model's own rule.

A text is written once, as the numbers of its units: the id of a unit that is a piece of its own,
or the place of the unit in a list of its block's other units. Texts are never exchanged: the table
is bucketed by block, and only the different units travel, in lists: a block deals its units by hash to
the lanes of the lattice, one list a lane, and gets one array of ids back for each list.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import partial
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from adtrail.plans.cut import scratch_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Units up to this many characters go through the lattice, whose state is one bit per boundary;
#: longer ones are merged with a heap.
LATTICE_CHARS = 60
BLOCK_BYTES = 28 << 20
#: Units in one row of a block's list.
LIST_ROWS = 50_000
#: Texts turned into Python objects at a time.
SLICE_ROWS = 256
#: Lanes of the lattice for each block of text.
LATTICE_LANES = 8
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
#: The piece number of a character that no piece holds.
_NONE = (1 << 20) - 1


@dataclass(frozen=True)
class Pieces:
    """A model's pieces. ``kind`` is unigram (1) or BPE (2)."""

    kind: int
    table: tuple  # (piece, id, score) of the pieces that text can match
    byte_ids: tuple  # 256 ids, or empty without byte fallback
    unknown: int
    surface: tuple  # bytes that each id stands for

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.table)


def load_pieces(path: str = MODEL) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    table = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == _NORMAL]
    if any(MARK in p.lstrip(MARK) or (("\n" in p) and p != "\n") for p, _, _ in table):
        raise ValueError("a piece crosses the units")
    raw = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
    surface = []
    for p in model.pieces:
        surface.append(bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE
                       else p.piece.replace(MARK, " ").encode() if p.type == _NORMAL
                       else " ⁇ ".encode() if p.type == _UNKNOWN else b"")
    return Pieces(model.trainer_spec.model_type, tuple(table),
                  tuple(raw[b] for b in range(256)) if len(raw) == 256 else (),
                  next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN), tuple(surface))


def whole_pieces(pieces: Pieces) -> tuple[dict, float]:
    """``(piece to id, bound)`` for a BPE model: the pieces that encode to themselves, and a score.
    Every piece above the bound has a score of its own and is worth less than all merges that lead to
    it, so among such pieces a merge never makes a better one possible, and one pass over the edges
    from best to worst merges like the rule that always takes the best. Bounded by the vocabulary."""
    score = {p: s for p, _, s in pieces.table}
    below = -float("inf")
    seen, bound, whole = set(), below, {}
    for piece, i, own in pieces.table:
        parts, worst = list(piece), float("inf")
        while len(parts) > 1:
            best, k = max((score.get(a + b, below), -k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == below:
                break
            if len(parts) > 2:
                worst = min(worst, best)
            parts[-k:2 - k] = [parts[-k] + parts[1 - k]]
        if len(parts) == 1:
            whole[piece] = i
        if own in seen or (len(parts) == 1 and worst <= own):
            bound = max(bound, own)
        seen.add(own)
    return whole, bound


def units(text: str) -> list[str]:
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def decode_ids(ids, surface) -> bytes:
    """The text behind ids; the mark that encoding puts first is taken off again."""
    out = b"".join([surface[i] for i in ids])
    return out[1:] if out[:1] == b" " else out


def _merge_long(unit: str, ids: dict, fallback) -> list[int]:
    """The BPE rule for one long unit, with a heap of neighbouring pairs."""
    left, right = list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
    size = [1] * len(unit)
    heap: list = []

    def offer(i):
        j = right[i] if i >= 0 else len(unit)
        if i >= 0 and j < len(unit):
            hit = ids.get(unit[i:i + size[i] + size[j]])
            if hit:
                heapq.heappush(heap, (-hit[1], i, size[i], size[j]))
    for i in range(len(unit)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if size[i] != a or right[i] >= len(unit) or size[right[i]] != b:
            continue
        j = right[i]
        size[i], size[j], right[i] = a + b, 0, right[j]
        if right[j] < len(unit):
            left[right[j]] = i
        offer(left[i])
        offer(i)
    out, i = [], 0
    while i < len(unit):
        hit = ids.get(unit[i:i + size[i]])
        out += [hit[0]] if hit else fallback(unit[i])
        i = right[i]
    return out


def _best_long(unit: str, ids: dict, fallback, longest: int, floor: float) -> list[int]:
    """The unigram rule for one long unit: Viterbi over its positions."""
    best = [(0.0, 0, [])] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(max(0, end - longest), end):
            hit = ids.get(unit[start:end])
            if hit or end - start == 1:
                score = best[start][0] + (hit[1] if hit else floor)
                if best[end] is None or score > best[end][0]:
                    best[end] = (score, start, [hit[0]] if hit else fallback(unit[start]))
    out, at = [], len(unit)
    while at:
        out[:0] = best[at][2]
        at = best[at][1]
    return out


def _encode_long(batches, pieces: Pieces):
    """Arrow batches of lists of units that are not for the lattice, with their ids."""
    ids = {p: (i, s) for p, i, s in pieces.table}
    floor = min(s for _, _, s in pieces.table) - 10.0

    def fallback(c):
        return [pieces.byte_ids[b] for b in c.encode()] if pieces.byte_ids else [pieces.unknown]
    for batch in batches:
        found = [[_merge_long(u, ids, fallback) if pieces.kind == 2
                  else _best_long(u, ids, fallback, pieces.longest, floor) for u in _split(text)]
                 for text in batch.column("units").to_pylist()]
        sizes = [np.array([len(x) for x in own], np.int64) for own in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([_narrow(n) for n in sizes], pa.binary()),
             pa.array([_narrow(np.concatenate(own)) for own in found], pa.binary())], names=_CODED)


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _part(e: Column, shift: int, bits: int) -> Column:
    return F.shiftright(e, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _merged(lattice: DataFrame, raw, by: Sequence[str]) -> DataFrame:
    """BPE: boundaries as bits; the best edge over exactly one inner boundary removes it. The edges
    that span no boundary but their own ends are then the pieces. Edges come from best to worst; one
    pass over them is enough but for units with ``_late`` edges (`whole_pieces`)."""
    def fits(bits, e):
        return (bits.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bits.bitwiseAND(e["inner"])) == 1)

    def merge(bits, e):
        return F.when(fits(bits, e), bits - bits.bitwiseAND(e["inner"])).otherwise(bits)

    def step(bits, _):
        best = F.get(F.filter("_wide", lambda e: fits(bits, e)), F.lit(0))
        return F.when(best.isNotNull(), bits - bits.bitwiseAND(best["inner"])).otherwise(bits)

    def chosen(b):
        wide = F.filter("_wide", lambda e: (b.bitwiseAND(e["ends"]) == e["ends"])
                        & (b.bitwiseAND(e["inner"]) == 0))
        one = F.filter("_one", lambda e: F.call_function("shiftright", b, _part(e, 26, 6)).bitwiseAND(F.lit(3)) == 3)
        # start, length and piece are the low bits, so they sort by start
        return F.sort_array(F.concat(
            F.transform(wide, lambda e: e["edge"].bitwiseAND(F.lit((1 << 32) - 1))), one))
    n = F.length("unit")
    every = _bit(n + 1) - 1
    bits = F.when(F.col("_late"), F.aggregate(F.sequence(F.lit(2), n), every, step)).otherwise(
        F.aggregate("_wide", every, merge))
    # one round of binding: the lambda sees the final bits
    path = F.aggregate(F.array(bits), F.array().cast("array<bigint>"), lambda _, b: chosen(b))
    ids = F.when(F.col("_raw"), F.flatten(F.transform(
        "_path", lambda e: F.when(_part(e, 0, 20) != _NONE, F.array(_part(e, 0, 20))).otherwise(raw(e))))
    ).otherwise(F.transform("_path", lambda e: _part(e, 0, 20)))
    return lattice.select(*by, "_raw", path.alias("_path")).select(*by, ids.alias("ids"))


def _viterbi(df: DataFrame, edges: str, by: Sequence[str]) -> DataFrame:
    """Unigram: the best (score, start, ids) up to each position, then the path backwards."""
    n = F.length("unit")
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"),
                             F.array().cast("array<int>").alias("ids")))

    def step(best, end):
        at = F.filter(edges, lambda e: e["start"] + e["len"] == end)
        return F.concat(best, F.array(F.array_max(F.transform(at, lambda e: F.struct(
            (F.get(best, e["start"])["score"] + e["score"]).alias("score"),
            e["start"].alias("start"), e["ids"].alias("ids"))))))
    def back(state, _):
        here = F.get(state["best"], state["at"])
        return F.when(state["at"] > 0, F.struct(
            state["best"].alias("best"), here["start"].alias("at"),
            F.concat(here["ids"], state["ids"]).alias("ids"))).otherwise(state)
    best = F.aggregate(F.sequence(F.lit(1), n), begin, step)
    first = F.struct(best.alias("best"), n.alias("at"), F.array().cast("array<int>").alias("ids"))
    return df.select(*by, F.aggregate(
        F.sequence(F.lit(1), n), first, back, lambda s: s["ids"]).alias("ids"))


def encode_units(found: DataFrame, pieces: Pieces, bound: float = float("inf"),
                 by: Sequence[str] = ("unit",)) -> DataFrame:
    """``found(unit)``, different units of 1 to ``LATTICE_CHARS`` characters, to ``(unit, ids)``.

    ``bound`` as in `whole_pieces`. Nothing is shuffled if ``found`` is partitioned by unit, or by other
    columns that ``by`` names with it. An edge travels as one number: the
    rank of its score, its start and length, and its piece (all ones: no piece).
    """
    spark = found.sparkSession
    rank = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces.table}, reverse=True))}
    last, late = len(rank), min((r for x, r in rank.items() if x <= bound), default=len(rank))
    if max(i for _, i, _ in pieces.table) >= _NONE:
        raise ValueError("too many pieces")
    # bounded by the vocabulary; met by hash, since a number is looked up faster than a text
    table = F.broadcast(spark.createDataFrame(
        pd.DataFrame([(p, rank[s] << 32 | i) for p, i, s in pieces.table], columns=["_name", "_code"]),
        "_name string, _code long").withColumn("_hash", F.xxhash64("_name")))
    n = F.length("unit")
    subs = (found.withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("len", F.explode(F.sequence(
                F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start")))))
            .withColumn("piece", F.col("unit").substr(F.col("start") + 1, F.col("len"))))
    code = F.coalesce("_code", F.lit(last << 32 | _NONE).cast("long"))
    at, end = F.col("start").cast("long"), F.col("start") + F.col("len")
    packed = code + F.shiftleft(at, 26) + F.shiftleft(F.col("len").cast("long"), 20)
    met = subs.withColumn("_hash", F.xxhash64("piece")).join(table, "_hash", "left").where(
        "piece = _name or len = 1").withColumn("_code", F.when(F.col("piece") == F.col("_name"), F.col("_code")))
    start, size, piece = (lambda e: _part(e, 26, 6)), (lambda e: _part(e, 20, 6)), (lambda e: _part(e, 0, 20))
    if pieces.byte_ids:
        by_byte = F.array(*[F.lit(i) for i in pieces.byte_ids])

        def raw(e):
            hexes = F.hex(F.encode(F.col("unit").substr(start(e) + 1, size(e)), "UTF-8"))
            return F.transform(F.sequence(F.lit(0), (F.length(hexes) / 2 - 1).cast("int")), lambda k: F.get(
                by_byte, F.conv(hexes.substr(k * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    else:
        def raw(e):
            return F.array(F.lit(pieces.unknown))
    wide = F.col("len") > 1
    if pieces.kind == 2:
        marks = met.select(
            *by, F.when(wide, F.struct(
                packed.alias("edge"), (_bit(F.col("start")) + _bit(end)).alias("ends"),
                (_bit(end) - _bit(F.col("start") + 1)).alias("inner"))).alias("_w"),
            F.when(~wide, packed.bitwiseAND(F.lit((1 << 32) - 1))).alias("_o"),
            (wide & (code >= late << 32)).alias("_l"), F.col("_code").isNull().alias("_r"))
        return _merged(marks.groupBy(*by).agg(
            F.sort_array(F.collect_list("_w")).alias("_wide"), F.collect_list("_o").alias("_one"),
            F.max("_l").alias("_late"), F.max("_r").alias("_raw")), raw, by)
    scores = F.array(*[F.lit(float(s)) for s in rank], F.lit(float(min(rank)) - 10.0))
    edges = met.select(*by, packed.alias("_edge")).groupBy(*by).agg(
        F.sort_array(F.collect_list("_edge")).alias("_p"))
    return _viterbi(edges.select(*by, F.transform("_p", lambda e: F.struct(
        start(e).alias("start"), size(e).alias("len"), F.get(scores, _part(e, 32, 24)).alias("score"),
        F.when(piece(e) != _NONE, F.array(piece(e))).otherwise(raw(e)).alias("ids"))).alias("e")), "e", by)


class _Numbers(dict):
    """Numbers of a block's units: the ids of whole pieces, and for others -1 - (k * (lanes + 1) + lane):
    the k-th unit of the lane that its hash names, or of a lane of its own if it is not for the lattice."""

    def __init__(self, whole: dict, lanes: int):
        super().__init__(whole)
        self.lanes = lanes
        self.others: dict[int, list[str]] = defaultdict(list)

    def __missing__(self, unit: str) -> int:
        short = len(unit) <= LATTICE_CHARS and unit != "\n"
        lane = zlib.crc32(unit.encode()) % self.lanes if short else self.lanes
        own = self.others[lane]
        self[unit] = -1 - (len(own) * (self.lanes + 1) + lane)
        own.append(unit)
        return self[unit]


def _listed(own: list[str]) -> str:
    """A list of units as one text. Only the line end holds one; it stands as the empty unit."""
    return "\n".join(["" if u == "\n" else u for u in own])


def _split(text: str) -> list[str]:
    return [u or "\n" for u in text.split("\n")]


def _number_texts(batches, whole: dict, block_bytes: int, lanes: int):
    """Arrow batches of texts to rows of their units' numbers and, after each block, rows of lists of
    the block's other units by lane. A block is a run of texts of one task."""
    block, numbers, held, kind = TaskContext.get().partitionId() << 32, _Numbers(whole, lanes), 0, None

    def close():
        lists = [(lane, a, _listed(own[a:a + LIST_ROWS])) for lane, own in numbers.others.items()
                 for a in range(0, len(own), LIST_ROWS)]
        n = len(lists)
        if n:
            lane, first, text = zip(*lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()),
                 pa.nulls(n, pa.binary()), pa.array(lane, pa.int32()), pa.array(first, pa.int32()),
                 pa.array(text, pa.string())], names=_STORED)
            # workers are reused, so memory that a block has left counts in the next stage too
            pa.default_memory_pool().release_unused()
    slices = (b.slice(a, SLICE_ROWS) for b in batches for a in range(0, b.num_rows, SLICE_ROWS))
    for batch in slices:
        kind, codes, sums = batch.column("_row").type, [], []
        for text in batch.column("_text").to_pylist():
            own = units(text)
            codes.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)).tobytes())
            raw = text.encode()
            sums.append(hashlib.md5(raw).digest())
            held += len(raw)
        n = len(codes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), batch.column("_row"), pa.array(codes, pa.binary()),
             pa.array(sums, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
             pa.nulls(n, pa.string())], names=_STORED)
        if held >= block_bytes + block_bytes // 4:
            yield from close()
            block, numbers, held = block + 1, _Numbers(whole, lanes), 0
    if held:
        yield from close()
    numbers = batch = None
    pa.default_memory_pool().release_unused()


_STORED = ["block", "_row", "codes", "sum", "lane", "first", "units"]
#: A list of units with its ids: how many each unit has, and all of them.
_CODED = ["_block", "lane", "first", "n", "ids"]


def _bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``df`` written once in the shared folder, in buckets of ``key``: as a bucketed table (a join on
    it by ``key`` with as many partitions exchanges the other side only) and as plain files."""
    spark, name, path = df.sparkSession, f"adtrail_{uuid.uuid4().hex}", scratch_path(df.sparkSession)
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name), spark.read.schema(df.schema).parquet(path)


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 with as few bytes each as the largest needs, after one byte that says how many."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _list_ids(lists: pa.Table, coded: pa.Table) -> pa.Table:
    """The lists of a lane with the ids of their units."""
    place = {u: i for i, u in enumerate(coded.column("unit").to_pylist())}
    ids = coded.column("ids").combine_chunks()
    offsets, flat = np.asarray(ids.offsets).astype(np.int64), np.asarray(ids.values)
    sizes, out = np.diff(offsets), []
    for text in lists.column("units").to_pylist():
        own = text.split("\n")
        at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        out.append((_narrow(sizes[at]), _narrow(_gather(flat, offsets[at], sizes[at]))))
    n, packed = zip(*out) if out else ((), ())
    return pa.table([lists.column("block"), lists.column("lane"), lists.column("first"),
                     pa.array(n, pa.binary()), pa.array(packed, pa.binary())], names=_CODED)


def _encode_block(docs: pa.Table, known: pa.Table, surface, lanes: int) -> pa.Table:
    """The texts of a block with the ids of its units."""
    pa.default_memory_pool().release_unused()
    # one flat array: every id at its own place, then the lists of the block's other units
    own = [_widen(x) for x in known.column("n").to_pylist()]
    flat = np.concatenate([np.arange(len(surface), dtype=np.int32), *map(_widen, known.column("ids").to_pylist())])
    places = [(first + np.arange(len(n))) * (lanes + 1) + lane for lane, first, n in zip(
        known.column("lane").to_pylist(), known.column("first").to_pylist(), own)]
    top = max([int(p[-1]) + 1 for p in places], default=0)
    starts, sizes, begin = np.zeros(top, np.int64), np.zeros(top, np.int64), len(surface)
    for place, n in zip(places, own):
        ends = begin + np.cumsum(n, dtype=np.int64)
        starts[place], sizes[place], begin = ends - n, n, ends[-1]
    del own, places
    if not len(starts):
        starts = sizes = np.zeros(1, np.int64)
    counts, parts, exact = [], [], []
    for batch in docs.select(["codes", "sum"]).to_batches(max_chunksize=SLICE_ROWS):
        rows = []
        for codes, digest in zip(batch.column("codes").to_pylist(), batch.column("sum").to_pylist()):
            code = np.frombuffer(codes, np.int32)
            other = np.maximum(-1 - code, 0)
            n = np.where(code < 0, sizes[other], 1)
            rows.append(_gather(flat, np.where(code < 0, starts[other], code), n))
            exact.append(hashlib.md5(decode_ids(rows[-1].tolist(), surface)).digest() == digest)
        own = np.array([len(r) for r in rows], np.int64)
        counts.append(own)
        parts.append(pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(np.concatenate(rows))))
    return pa.table({
        "_row": docs.column("_row"),
        "n_tokens": pa.array(np.concatenate([np.empty(0, np.int64), *counts])),
        "ids": pa.chunked_array(parts, pa.list_(pa.int32())),
        "round_trip": pa.array(exact, pa.bool_())})


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     model: str = MODEL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids`` and ``round_trip``, whether decoding the ids
    gives the text again.

    NULL counts as the empty text, which has no ids. Repeated rows and ids keep their rows, an
    empty table gives no rows, and further columns are ignored whatever their names. A text with
    the mark itself in it encodes like one with spaces, so it does not come back.
    """
    pieces = load_pieces(model)
    whole, bound = whole_pieces(pieces) if pieces.kind == 2 else ({}, 0.0)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    buckets = max(1, -(-total // block_bytes))
    kind = docs.schema[doc_id].dataType.simpleString()
    df = docs.select(F.struct(F.col(doc_id).alias("i")).alias("_row"), body.alias("_text"))
    # a task numbers about one block: the fewer blocks, the fewer units are in several of them
    lanes = buckets * LATTICE_LANES
    stored, files = _bucketed(df.coalesce(buckets).mapInArrow(
        partial(_number_texts, whole=whole, block_bytes=block_bytes, lanes=lanes),
        f"block bigint, _row struct<i:{kind}>, codes binary, sum binary, lane int, first int, units string"),
        "block", buckets)
    lists = files.where("units is not null").select("block", "lane", "first", "units")
    short = lists.where(F.col("lane") < lanes).repartition(lanes, "lane")
    # the different units are taken from all columns, so that both uses read one exchange
    once = short.select("block", "lane", "first", F.explode_outer(F.split("units", "\n", -1)).alias("unit")).groupBy(
        "lane", "unit").agg(F.max(F.col("block") + F.col("first")).alias("_any")).where("_any is not null")
    coded = encode_units(once.select("lane", "unit"), pieces, bound, ["lane", "unit"])
    shape = "_block bigint, lane int, first int, n binary, ids binary"
    known = short.groupBy("lane").cogroup(coded.withColumnRenamed("lane", "_lane").groupBy("_lane")).applyInArrow(
        _list_ids, shape).unionByName(
        lists.where(F.col("lane") == lanes).mapInArrow(partial(_encode_long, pieces=pieces), shape))
    surface = pieces.surface
    out = stored.where("codes is not null").select("block", "_row", "codes", "sum").groupBy("block").cogroup(
        known.repartition(buckets, "_block").groupBy("_block")).applyInArrow(
        lambda a, b: _encode_block(a, b, surface, lanes),
        f"_row struct<i:{kind}>, n_tokens bigint, ids array<int>, round_trip boolean")
    return out.select(F.col("_row.i").alias(doc_id), "n_tokens", "ids", "round_trip")


def decode_documents(coded: DataFrame, doc_id: str = "doc_id", ids: str = "ids",
                     model: str = MODEL) -> DataFrame:
    """``(doc_id, ids)`` back to ``(doc_id, text)``; NULL or no ids give the empty text, and bytes
    that form no character are replaced."""
    surface = load_pieces(model).surface

    def back(batches):
        for b in batches:
            texts = [decode_ids(x or (), surface).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())],
                                             names=[doc_id, "text"])
    kind = coded.schema[doc_id].dataType.simpleString()
    return coded.select(doc_id, ids).mapInArrow(back, f"`{doc_id}` {kind}, text string")
