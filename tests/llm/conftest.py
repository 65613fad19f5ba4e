import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with extra columns, one of a name that operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", 1.5, "own") for d, t in rows], "doc_id long, text string, lang string, source string, score double, ids string")

    return make
