import pytest
from pyspark.sql import types as T

from tidemill.llm.common import Scratch

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns that clash with names the operators use for their results
    T.StructField("size", T.StringType()), T.StructField("Kept", T.StringType()), T.StructField("label", T.StringType()),
])

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta", "en", "a"),  # a repeated row
    (3, "", "en", "b"),
    (4, None, None, None),
    (None, "alpha beta gamma delta epsilon zeta", "en", "b"),
    (None, None, None, None),
    (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "c"),
    (7, LONG + " tail", "en", "c"),
    (8, "one", "en", None),
    (8, "another text of the same id", "fr", "c"),
    (-3, "é ü ß 漢字 😀 \u0000 x", "xx", "ü"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and clashing columns."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "s", "k", "l") for i, t, g, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")
