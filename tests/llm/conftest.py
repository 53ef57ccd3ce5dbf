import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


#: (doc_id, text, lang, source, n_chars): nulls, empty texts, repeated rows, ties, a very long text and one without blanks.
ODD = [
    (1, "a b c d e f g h i j", "en", "x", 19),
    (1, "a b c d e f g h i j", "en", "x", 19),
    (2, "A B C D E F G H I J", "en", None, 19),
    (3, None, None, "x", None),
    (4, "", "fr", "y", 0),
    (None, "a b c d e f g h i j", "en", "y", 19),
    (None, None, None, None, None),
    (5, " \t\n ", "en", "x", 4),
    (6, "word", "de", "x", 4),
    (7, "two words", "de", "z", 9),
    (8, "TWO WORDS", "de", "z", 9),
    (9, " ".join(f"w{i % 7001}" for i in range(60_000)), "en", "x", 0),
    (10, "z" * 300_000, "en", "x", 300_000),
    (11, "é ü ## $$ !! " * 40, "es", "x", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with columns whose names clash with those that operators add."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("size", "n", "id", "part", "shard", "k1", "key", "score", "position", "h", "grp", "hash"):
        df = df.selectExpr("*", f"'junk' AS {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
