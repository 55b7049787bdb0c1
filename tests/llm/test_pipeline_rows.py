"""Every stage on odd rows: repeated and missing ids, long texts, columns whose names stages use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .conftest import SF

WORDS = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, WORDS), (1, WORDS), (1, "another text of the first id, quite unlike it"), (2, WORDS + " tail"), (None, WORDS + " end"), (None, "no id and no copy"), (None, None),
    (5, "xylonger"), (5, "a unique text"), (3, "xy longer"), (6, ""), (7, None), (8, "long " * 50_000), (9, 'password = "abcdefgh12345"'), (9, "x" * 30_000),
]
NAMES = ("score", "score_", "text_sha256", "key_id", "key_row", "row_number", "kept", "component_id", "a.b", "c`d", "n_chars", "length")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, mark long")
    return df.select("doc_id", "text", *(F.lit(-7).cast("long").alias(n) for n in NAMES), "mark")


@pytest.fixture(scope="module")
def out(spark, docs):
    got = {}
    for name, stage in P.STAGES[:-1]:
        df = stage(spark, docs, SF)
        assert df.columns == docs.columns and df.dtypes == docs.dtypes, name
        got[name] = df.collect()
    return got


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_columns_pass_as_they_are(out, name):
    for r in out[name]:
        assert all(r[n] == -7 for n in NAMES if (name, n) != ("secrets", "n_chars"))


def test_quality_keeps_or_drops_texts_whole(out):
    kept = {r.mark for r in out["quality"]}
    for a, b in ((0, 1), (6, 10), (10, 11)):
        assert (a in kept) == (b in kept)


def test_exact_by_row(out):
    assert {r.mark for r in out["exact"]} in [{one, 2, 3, 4, 5, 8, 9, 10, 12, 13, 14} for one in (0, 1)]


def test_near_by_row(out):
    """The rows of one text and its near copies are one group, whatever their ids; other texts of those ids stay."""
    kept = {r.mark for r in out["near"]}
    assert len(kept & {0, 1, 3, 4}) == 1 and kept & {0, 1}
    assert kept - {0, 1} == {2, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14}


def test_secrets_by_row(out):
    texts = {r.mark: (r.text, r.n_chars) for r in out["secrets"]}
    assert len(texts) == len(ROWS) and texts[6][0] is None and texts[13] == ("[secret]" + '"', 9)
    assert all(texts[k][0] == t for k, (_, t) in enumerate(ROWS) if k != 13)


def test_packing_by_row(spark, docs):
    rows = P.packing(spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert sum(r.length for r in rows if r.doc_id == 8) == max(r.start + r.length for r in rows if r.doc_id == 8) > 50_000


def test_stages_without_rows(spark, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
