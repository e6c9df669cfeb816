import pytest

pytest.importorskip("quire.llm")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def docs(spark):
    """Documents (id, text) with columns whose names the operators use themselves."""

    def make(rows):
        wide = [(*r, 1, "x", 0.5, [1], "y") for r in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, id long, tag string, score double, spans array<int>, component string")

    return make
