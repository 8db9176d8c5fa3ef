import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows as (tab, id, text, held) with an extra column whose name clashes with one of the operators' own."""

    def build(texts, tab="prompts", held=()):
        rows = [(tab, i, t, i in held, "x") for i, t in texts]
        return spark.createDataFrame(rows, "tab string, id bigint, text string, held boolean, n string")

    return build
