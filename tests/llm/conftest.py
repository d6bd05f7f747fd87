import pytest

#: Columns that clash with names used inside the operators.
CLASH = "_row string, _t string, words string, n_words string, id string, block string, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """``make_docs(rows)`` from (doc_id, text[, source]) with the columns of documents and clashing
    extra ones."""
    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]))
                + (("x",) * 7 if extra else ()) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame(full, schema + (", " + CLASH if extra else ""))
    return make
