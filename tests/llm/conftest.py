import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Intermediate tables of the tests go to a folder of their own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from texts (ids by place), with a column that no operator should trip over."""

    def make(texts, ids=None, langs=None):
        rows = [(i if ids is None else ids[k], t, langs[k] if langs else None, "s", None if t is None else len(t), "clash") for k, (i, t) in enumerate(enumerate(texts))]
        return spark.createDataFrame(rows, DOCS + ", score string")

    return make
