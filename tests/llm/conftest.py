import pytest
from odd_rows import ODD_ROWS

pytest.importorskip("lodegraph.llm")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, head string, node long, label string, block long"):
    """Documents with nulls, repeated rows, empty and long texts, and columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), "h", 7, "x", 3) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture
def docs(spark):
    def make(rows):
        return frame(spark, rows)

    return make


@pytest.fixture
def odd(spark):
    return frame(spark, ODD_ROWS)


@pytest.fixture
def none(spark):
    return frame(spark, [])
