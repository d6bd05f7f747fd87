"""Token counts from flat token files without an index.

A token file is 16-bit ids, little-endian, one end-of-document id after each text and nothing else.
Each file is searched block by block with vectorised compares; a block reports its separators, and
a prefix scan over the blocks of a file carries the position of the last separator and the number
of separators across, so that documents that span blocks are stitched together.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
BLOCK_TOKENS = 1 << 18
#: How the vocabulary cuts a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _tokenize(batches, ranks: dict, end: int):
    import tiktoken

    bpe = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for batch in batches:
        out = [np.array(bpe.encode_ordinary(t), np.uint16).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])


def write_token_files(docs: DataFrame, path: str, text: str = "text", vocabulary: str = VOCABULARY,
                      end: int = END) -> None:
    """Tokenise texts into flat files, one per partition, in row order; NULL counts as empty.

    The text writer puts its separator after each row and writes string bytes as they are, so the
    separator is the end id's two bytes. A file stays well below what a task can hold, because it
    comes from one input split.
    """
    import base64

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= end or end >= 1 << 16:
        raise ValueError("ids must fit 16 bits and stay below the end id")
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInArrow(
        partial(_tokenize, ranks=ranks, end=end), "ids binary")
    rows.select(F.col("ids").cast("string")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", end.to_bytes(2, "little").decode("latin-1")).text(path)


def _scan(batches, end: int, block: int):
    """Arrow batches (file, content) to one row per block: its start, its separators' positions."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(content.as_buffer(), np.uint16)
            rows: dict[str, list] = {k: [] for k in ("file", "start", "size", "at")}
            for s in range(0, max(len(ids), 1), block):
                part = ids[s:s + block]
                rows["file"].append(name)
                rows["start"].append(s)
                rows["size"].append(len(part))
                rows["at"].append(np.flatnonzero(part == end) + s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["file"], pa.string()), pa.array(rows["start"], pa.int64()),
                 pa.array(rows["size"], pa.int64()), pa.array([list(a) for a in rows["at"]], pa.list_(pa.int64()))],
                names=["file", "start", "size", "at"])


def count_tokens(spark: SparkSession, path: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, doc_no, start, n_tokens`` of every document in the flat files below ``path``.

    ``doc_no`` counts from 0 inside the file and ``start`` is the document's first token. Tokens
    after the last separator are a document that is not ended, if there are any; an empty document
    has 0 tokens, an empty file none. A file must fit into a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    blocks = files.select("path", "content").mapInArrow(
        partial(_scan, end=end, block=block_tokens), "file string, start bigint, size bigint, at array<bigint>")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("start").rowsBetween(1, 1)
    scanned = blocks.withColumns({
        "_last": F.coalesce(F.max(F.element_at(F.when(F.size("at") > 0, F.col("at")), -1)).over(before), F.lit(-1)),
        "_seen": F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)),
        "_more": F.max("start").over(after).isNotNull()})
    tail = F.col("start") + F.col("size")
    open_ = ~F.col("_more") & (F.coalesce(F.element_at(F.when(F.size("at") > 0, F.col("at")), -1),
                                          F.col("_last")) + 1 < tail)
    ends = F.when(open_, F.concat("at", F.array(tail))).otherwise(F.col("at"))
    docs = scanned.withColumn("_ends", ends).select("file", "_last", "_seen", "_ends", F.posexplode("_ends"))
    first = F.coalesce(F.get("_ends", F.col("pos") - 1), F.col("_last")) + 1
    return docs.select("file", (F.col("_seen") + F.col("pos")).cast("long").alias("doc_no"), first.alias("start"),
                       (F.col("col") - first).alias("n_tokens"))
