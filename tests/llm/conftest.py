import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text) as documents, with other columns and clashing names."""

    def make(rows):
        full = [(i, t, None, "src", len(t or ""), "mine", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, score int")

    return make


#: Nulls in any column, empty and long texts, ties and repeated rows.
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "the quick brown fox jumps"), (7, "the quick brown fox jumps"), (7, "the quick brown fox jumps"),
    (8, "the quick\nbrown  fox jumps"), (None, "the quick brown fox jumps"), (9, "é ﷽ 🎉 日本語 \x00 x"), (10, "word " * 30_000), (11, "x" * 50_000),
]


@pytest.fixture(scope="session")
def hard(docs_of):
    return docs_of(HARD)
