import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp double, kept string"


def rows_of(texts, lang="en", source="s0"):
    return [(i, t, lang, source, len(t or ""), "clash", 1.5, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with clashing extra columns: from texts, or from whole rows."""

    def make(texts=(), rows=None):
        return spark.createDataFrame(rows if rows is not None else rows_of(texts), DOCS).repartition(3)

    return make


ODD = [None, "", " ", "\n\n\t", "one", "One two three four five six seven", "ß é ñ 漢字 \U0001f600 x", "a " * 30000, "w" * 50000, "one", "x\x1cy z w", "<|endoftext|> a"]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD
