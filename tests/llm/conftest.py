import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, gone int, key string, spans int, bucket int, ids int"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text) pairs, in two partitions, with extra columns of clashing names."""

    def make(pairs, lang=None):
        rows = [(i, t, lang[n] if lang else "en", "s", len(t or ""), "r", 1, "k", 2, 3, 4) for n, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA).repartition(2)

    return make


#: Nulls, empty and odd texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (5, "same row"), (5, "same row"), (6, "a" * 3000), (7, "one"), (8, "Ünï ςΣ 日本 \x1c x"), (9, "line\n\n\nline\nline")]
