import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use inside.
CLASHING = ("row", "key", "size", "line", "site", "group", "target", "print", "ids_", "__row")


def sentence(seed: int, n: int) -> str:
    """n invented words that depend on the seed."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


def odd_rows():
    long = "\n".join(sentence(i, 40) for i in range(300)) + "x" * 20_000
    return [
        (1, "", "en", "a", 0),
        (2, None, "en", None, None),
        (3, long, "en", "a", len(long)),
        (4, sentence(4, 60), "en", "b", 1),
        (4, sentence(4, 60), "en", "b", 1),
        (5, sentence(4, 60), None, "c", 1),
        (6, sentence(4, 59) + " other", "en", "c", 1),
        (None, sentence(8, 30), "en", "a", 1),
        (None, None, None, None, None),
        (7, "one", "en", "b", 3),
        (8, "two words", "en", "", 9),
        (9, "ünïcödé 𝒳   Σ end", "en", "é", 1),
        (10, "   \n\t ", "en", "a", 6),
        (-5, sentence(11, 5), "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, very long and repeated texts, and further columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), DOCS)
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
