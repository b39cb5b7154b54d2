"""Small documents that hold every awkward case."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank texts, ties and repeated rows, a very long text, and extra columns whose names clash."""
    long = " ".join(f"word{i % 977} next{i % 13}" for i in range(30_000))
    rows = [(1, "same text here"), (2, "same text here"), (2, "same text here"), (None, "same text here"), (3, None), (None, None), (4, ""), (5, "   \n\t "), (6, "é ñ ü 日本 😀"), (7, long), (8, long + " tail"), (9, "one"), (9, "other text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("score", "class_id", "shard", "spans", "ids", "n_items", "lang_pred", "source", "lang")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
