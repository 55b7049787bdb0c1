import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: Ids and texts of the odd cases: null, empty, blank, ties, repeated rows, no id, one very long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE "), (5, "ONE "), (6, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (None, None),
    (8, "é ß 你好 😀    x\u0000y"), (9, "word " * 60_000), (10, "token = \"abcdefgh1234\" " * 3), (11, "x" * 5000), (-3, "one"),
]
CLASHES = ("n_shingles", "digest", "bands", "family", "chunk", "component", "keep_id", "score", "held_out", "length", "rank", "part", "spans", "h", "same", "k", "x")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd cases under extra columns whose names operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit("?").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
