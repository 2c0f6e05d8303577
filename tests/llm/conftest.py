import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in any column, empty and odd texts, repeated rows and ties.
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (None, "A text without an id", "en", "a", 20),
    (None, None, None, None, None),
    (4, "Tab\there and  two spaces\n\n new line 　 end ", "en", "b", 40),
    (5, "tab\there AND  two spaces\n\n new line 　 end ", "en", "b", 40),
    (5, "tab\there AND  two spaces\n\n new line 　 end ", "en", "b", 40),
    (6, "Été été 😀 ▁ naïve don't I'LL 12345 <|endoftext|>".encode("utf-16", "surrogatepass").decode("utf-16"), "fr", "b", 50),
    (7, "word " * 30000, "en", "c", 150000),
    (8, "x" * 20000, "en", "c", 20000),
]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(spark, awkward):
    """The same rows with more columns, named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["fp", "norm", "part", "rank", "length", "piece", "row", "node", "ids", "kept", "keep_id", "text_sha256", "start", "score", "n_words"]
    return awkward.withColumns({n: F.lit(n) for n in names})


@pytest.fixture
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
