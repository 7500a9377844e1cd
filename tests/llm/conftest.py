import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table; rows are texts or (doc_id, text)."""

    def make(*rows):
        full = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in full], DOCS)

    return make
