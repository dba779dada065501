import pytest

from cairnfield.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """A documents table from texts, with columns whose names operators use within."""

    def make(texts, ids=None, langs=None):
        rows = [(i if ids is None else ids[k], t, (langs[k] if langs else None), "s", len(t or ""), 1.0, "x", 7) for k, (i, t) in enumerate(enumerate(texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, pos int")

    return make
