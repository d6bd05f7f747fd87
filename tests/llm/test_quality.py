import re
from collections import Counter

from adtrail.llm.quality import quality_filter, quality_scores

GOOD = " ".join(f"word{i} the and{i}" for i in range(40))


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(covered))


def test_counts_match_brute_force(make_docs):
    texts = [None, "", " \t\n", GOOD, "a b c a b c", "a a a a", "x\ny\nx\n\n x", "é # ü|<> z",
             "p q r s p q r", GOOD + "\n" + GOOD, "w " * 30000, "\x0b".join("abcabc")]
    rows = list(enumerate(texts)) + [(3, GOOD), (None, GOOD)]
    got = quality_scores(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = GOOD if r.doc_id is None else texts[r.doc_id]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_filter_keeps_prose_and_all_columns(make_docs):
    table = " | ".join(f"c{i}" for i in range(80))
    docs = make_docs([(1, GOOD), (2, table), (3, None), (4, "short"), (5, GOOD.upper() + " the of")])
    kept = quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_empty_table(make_docs):
    assert quality_scores(make_docs([])).count() == 0


def test_clean_text_in_languages_without_a_list_is_kept(spark):
    def prose(words):
        return " ".join(f"{w}{i}" for i in range(30) for w in words.split())
    russian, greek = prose("мы шли домой"), prose("πήγαμε στο σπίτι")
    korean, arabic, polish = prose("우리는 집으로 갔다"), prose("ذهبنا إلى البيت"), prose("szliśmy przez las")
    rows = [(1, russian, "ru", True), (2, greek, "el", True), (3, korean, None, True), (4, arabic, "", True),
            (5, polish, "pl-PL", True), (6, polish, None, False), (7, polish, "en", False), (8, russian, "en", True),
            (9, "# 12 " * 5 + " ".join(f"{i}" for i in range(1000, 1090)), None, False),
            (10, " ".join(["мы"] * 90), "ru", False), (11, " ".join(f"the house{i} of" for i in range(40)), "en-GB", True)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    want = {r[0]: r[3] for r in rows}
    assert {r.doc_id: r.kept for r in quality_scores(docs).collect()} == want
    assert {r.doc_id for r in quality_filter(docs).collect()} == {i for i, k in want.items() if k}
    bare = docs.drop("lang").where("doc_id in (1, 6)")
    assert [r.doc_id for r in quality_filter(bare).collect()] == [1]


def test_sql_knows_the_language_rule(spark):
    import duckdb

    from adtrail.llm.q_quality import SQL
    russian = " ".join(f"мы{i} шли{i} домой{i}" for i in range(30))
    polish = " ".join(f"szliśmy{i} przez{i} las{i}" for i in range(30))
    rows = [(1, russian, "ru"), (2, russian, "en"), (3, polish, " PL-pl"), (4, polish, "en"), (5, polish, None), (6, GOOD, "en"),
            (7, polish, "und"), (8, None, "ru"), (9, russian, None), (10, "# 1 " * 60, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = {r[0]: r[1] for r in con.sql(f"select doc_id, kept from ({SQL})").fetchall()}
    assert {r.doc_id: r.kept for r in quality_scores(docs).collect()} == want
    assert {i for i, kept in want.items() if kept} == {1, 2, 3, 6, 9}
