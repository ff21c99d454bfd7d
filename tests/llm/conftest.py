import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with further columns whose names operators also use inside."""
    def make(rows, cols=("doc_id", "text"), types=("long", "string")):
        schema = ", ".join(f"{c} {t}" for c, t in zip(cols, types, strict=True))
        return spark.createDataFrame([tuple(r) for r in rows], schema)
    return make


WEIRD = [(1, None), (2, ""), (3, " \n\t"), (None, "a text without an id"), (4, "same"), (4, "same"),
         (5, "é€😀 x" * 50), (6, "word " * 30000)]


@pytest.fixture(scope="session")
def weird():
    return list(WEIRD)
