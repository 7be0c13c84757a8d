import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977} more{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, long), (5, long), (5, long), (6, "one"), (7, "  \t "), (8, "É ñ ß 中文 ١"), (None, "x y z w")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("node", "id", "lang", "tile", "n", "gone", "token", "key")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
