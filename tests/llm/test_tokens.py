import base64

import numpy as np
import tiktoken

from adtrail.llm.q_tokens import op6_token_counts
from adtrail.llm.tokens import END, PATTERN, VOCABULARY, count_tokens, write_token_files


def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    enc = bpe()
    want = {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)


def test_edge_cases(spark, make_docs, tmp_path):
    texts = [None, "", "a", "long words " * 20000, "<|endoftext|>", "", "é\n\n", "a"]
    path = str(tmp_path / "flat")
    write_token_files(make_docs(list(enumerate(texts))).coalesce(1), path)
    enc = bpe()
    for block in (1 << 18, 1000, 7):
        got = sorted((r.doc_no, r.n_tokens) for r in count_tokens(spark, path, block_tokens=block).collect())
        assert got == [(i, len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts)]


def test_blocks_are_stitched(spark, tmp_path):
    """Random files against a plain scan, with and without an end at the end."""
    rng = np.random.default_rng(1)
    want = []
    for k in range(6):
        ids = rng.choice([1, 2, 3, END], int(rng.integers(0, 200)), p=[0.4, 0.3, 0.25, 0.05]).astype(np.uint16)
        (tmp_path / f"f{k}").write_bytes(ids.tobytes())
        n, start, doc = 0, 0, 0
        for i, x in enumerate(ids):
            if x == END:
                want.append((f"f{k}", doc, start, i - start))
                start, doc = i + 1, doc + 1
        if start < len(ids):
            want.append((f"f{k}", doc, start, len(ids) - start))
    for block in (1, 5, 64, 1000):
        got = count_tokens(spark, str(tmp_path), block_tokens=block).collect()
        assert sorted((r.file.rpartition("/")[2], r.doc_no, r.start, r.n_tokens) for r in got) == sorted(want)


def test_empty_table(spark, make_docs, tmp_path):
    write_token_files(make_docs([]), str(tmp_path / "none"))
    assert count_tokens(spark, str(tmp_path / "none")).count() == 0
