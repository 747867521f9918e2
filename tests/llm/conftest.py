import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents with an extra column whose name some operators use themselves."""

    def make(texts, ids=None, lang="en", source="s"):
        rows = [(i, t, lang, source, len(t or ""), "x", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, DOCS + ", fp string, n int")

    return make
