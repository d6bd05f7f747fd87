import numpy as np
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from adtrail.llm.pieces import (MODEL, _encode_block, _list_ids, _listed, _Numbers, _split, decode_documents,
                                encode_documents, load_pieces)

TEXTS = [
    None, "", " ", "a", "  two  spaces and   three ", "new\nline\r\n\ttab", "Übergröße naïve ñandú 日本語 😀",
    "x" * 400, "ab " * 3000, "!" * 61, "    code();\n        return {};\n", "the " + "abc" * 100,
    "<s> </s> <unk> <0x41>", "\x00\x01 control", "한국어 텍스트 и русский текст", "1234567890 " * 20,
]


def sample():
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEÄöüßéñ .,;:!?()\n\t_-0123456789") + ["  ", "ing", "tion"]
    return TEXTS + ["".join(rng.choice(letters, int(rng.integers(1, 300)))) for _ in range(150)]


def test_ids_are_the_models_own(make_docs):
    texts = sample()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts)) + [(3, "a"), (None, "none")]
    got = encode_documents(make_docs(rows), block_bytes=4000)
    assert got.count() == len(rows)
    for r in got.collect():
        text = "none" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == model.encode(text), text[:80]
        assert r.n_tokens == len(r.ids) and r.round_trip
    back = {r.doc_id: r.text for r in decode_documents(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_viterbi_finds_the_best_path_of_a_unigram_model(make_docs, tmp_path):
    """The same pieces read as a unigram model, against the best score by plain recursion; the
    library, which keeps scores in single precision, finds none better."""
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score /= 1000.0
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = load_pieces(path)
    score = {i: s for _, i, s in pieces.table}
    by_name = {p: s for p, _, s in pieces.table}
    texts = ["the transformation of words", "Weltanschauung", "a" * 70, "internationalisation rules"]
    for r in encode_documents(make_docs(list(enumerate(texts))), model=path).collect():
        t = "▁" + texts[r.doc_id].replace(" ", "▁")
        best = [0.0]
        for end in range(1, len(t) + 1):
            best.append(max(best[k] + by_name.get(t[k:end], -1e18) for k in range(max(0, end - 16), end)))
        found = sum(score[i] for i in r.ids)
        assert abs(found - best[-1]) < 1e-6 and r.round_trip
        assert found > sum(score[i] for i in model.encode(texts[r.doc_id])) - 1e-3


def test_empty_table(make_docs):
    assert encode_documents(make_docs([])).count() == 0


def test_units_travel_in_lists():
    """A block's units go to their lanes as one list each, and their ids come back to their places."""
    rng = np.random.default_rng(4)
    lanes, texts = 5, [f"▁w{i}" for i in range(4000)] + ["\n", "▁" + "x" * 80]
    ids = {u: rng.integers(0, 32_000, int(rng.integers(1, 6))).tolist() for u in texts}
    ids["▁w7"], ids["▁w8"] = list(range(300)), [31_999]
    numbers = _Numbers({"▁whole": 5}, lanes)
    codes = np.array([numbers[u] for u in [*texts, "▁whole"]], np.int32).tobytes()
    assert set(numbers.others[lanes]) == {"\n", "▁" + "x" * 80}
    rows = []
    for lane, own in numbers.others.items():
        lists = [(3, lane, a, _listed(own[a:a + 300])) for a in range(0, len(own), 300)]
        assert [u for r in lists for u in _split(r[3])] == own
        if lane < lanes:
            coded = pa.table({"unit": own[::-1], "ids": pa.array([ids[u] for u in own[::-1]], pa.list_(pa.int32()))})
            rows.append(_list_ids(pa.table([pa.array(c) for c in zip(*lists)], names=["block", "lane", "first", "units"]),
                                  coded))
    known = pa.concat_tables(rows)
    assert known.num_rows < 20 and known.nbytes < 10 * len(texts)
    tail = pa.table({"_block": [3], "lane": pa.array([lanes], known.schema.field("lane").type), "first": [0],
                     "n": [b"\x01" + bytes([len(ids[u]) for u in numbers.others[lanes]])],
                     "ids": [b"\x02" + np.concatenate([ids[u] for u in numbers.others[lanes]]).astype("<u2").tobytes()]})
    docs = pa.table({"_row": [0], "codes": pa.array([codes], pa.binary()), "sum": pa.array([b""], pa.binary())})
    got = _encode_block(docs, pa.concat_tables([tail, known]), [b"x"] * 32_000, lanes)
    assert got.column("ids").to_pylist() == [[i for u in texts for i in ids[u]] + [5]]
