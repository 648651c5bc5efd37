import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts, or (doc_id, text) pairs, or (doc_id, text, source)."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, source = (i, r, "src") if not isinstance(r, tuple) else (*r, "src")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Cases that every operator takes: null and empty texts, white space, a null id, a repeated row, a long text.
HARD = [(1, None), (2, ""), (3, " \t\n"), (None, "a text without an id, which is of some length"), (5, "twice the same row"), (5, "twice the same row"), (6, "word " * 30_000), (7, "é ß 漢字 🙂\r\n\x00 end")]


@pytest.fixture
def hard_docs(make_docs):
    from pyspark.sql import functions as F

    # Extra columns with names that operators use themselves.
    return make_docs(HARD).withColumns({c: F.lit("x") for c in ("kept", "node", "score", "bucket", "spans", "line", "comp", "n_words", "_doc", "_hash", "_dropped", "_th", "row", "text_hash", "key", "first", "size", "g", "r", "d")})


@pytest.fixture
def no_docs(make_docs):
    return make_docs([])
