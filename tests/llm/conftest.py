import pytest

EDGE = [
    (1, None, "en", "s1", 0),
    (2, "", "en", "s1", 0),
    (3, "plain words that go on for a while, and then some more words to make shingles of", "en", None, 5),
    (3, "plain words that go on for a while, and then some more words to make shingles of", "en", None, 5),
    (None, "a text without an id", None, "s2", None),
    (5, "plain words that go on for a while, and then some more words to make shingles of", "de", "s3", 5),
    (6, "é" * 5000 + " 日本語 \x00 <|endoftext|> 'll", "fr", "s4", 5000),
    (7, "long " * 20000, "en", "s5", 100000),
    (8, "mail a.b.1@mail.example.com, card 4041894974608795, call +1 (988) 555-2485, password=abcdef123 on 2021-02-28", "en", "s6", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = ("ids", "n_tokens", "row_id", "node", "label", "score", "spans", "part", "rank", "keys", "made", "seen", "row", "length")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and further columns with clashing names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def edge_texts():
    return [(i, t or "") for i, t, *_ in EDGE]
