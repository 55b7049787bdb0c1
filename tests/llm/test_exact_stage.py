"""The exact stage on tables with null and repeated ids, and against all groups of the table."""

import corpus_pipeline as P

from .conftest import SF
from .test_pipeline import exact

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = P.exact(spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_decisions_go_with_the_row(spark):
    rows = [
        (1, "a b"), (None, "a b"), (None, "ab"),  # rows without an id go if one has an id
        (None, "c"), (None, "c "), (None, "c "),  # or else one of the longest stays
        (2, "d"), (2, "d"), (2, "d  "), (3, "d"),  # one row of the kept id
        (4, "a b"), (4, "e"),  # the copy goes, the other text of the id stays
    ]
    assert left(spark, rows) == sorted([(1, "a b"), (None, "c "), (2, "d  "), (4, "e")], key=str)


def test_unique_ids_as_before(spark, documents, texts):
    assert {r.doc_id for r in P.exact(spark, documents, SF).collect()} == exact(texts)


def test_equal_ids_and_texts_with_other_columns(spark):
    """What stays does not depend on how rows arrive, and columns that cannot be compared pass."""
    from itertools import permutations

    from pyspark.sql import functions as F

    rows = [(1, "a b", "y"), (1, "a b", "x"), (1, "ab", "w"), (1, "a b", "x"), (2, "c", "z")]
    kept = set()
    for k, order in enumerate(permutations(rows)):
        if k % 24 == 0:
            docs = spark.createDataFrame(list(order), "doc_id long, text string, source string").withColumn("more", F.create_map(F.lit("k"), F.col("source")))
            out = P.exact(spark, docs, SF)
            assert out.columns == docs.columns
            kept.add(str(sorted((r.doc_id, r.text, r.source, r.more) for r in out.collect())))
    assert kept == {str([(1, "a b", "x", {"k": "x"}), (2, "c", "z", {"k": "z"})])}
