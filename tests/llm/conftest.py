import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns that clash in case."""

    def make(*rows):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1) for r in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, size int"
        return spark.createDataFrame(data, kinds)

    return make
