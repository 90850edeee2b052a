import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "one two three four"), (2, None), (3, ""), (4, "  \n\t "), (5, long), (6, long), (7, "one two three four"), (7, "one two three four"), (None, "one two three four"), (8, "!!! 123"), (9, "Ünïcödé ß 中文 🙂")]
    return spark.createDataFrame([Row(doc_id=i, text=t, lang=None, source=None, n_chars=None, score=1.0, n_words="x", items=7, LICENCES="y", copies=3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, items int, LICENCES string, copies int")
