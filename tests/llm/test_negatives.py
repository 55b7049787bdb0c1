"""Radix selection against sorting all scores."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import negatives as N
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def _plain(rows, anchor, p=N.Mining()):
    """All scores of each anchor in order, in Python integers."""
    known = [(i, label, [math.floor(p.scale * float(x)) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, label, v) in enumerate(known):
        if a is None or not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i or 0, j, other) for j, (i, other, w) in enumerate(known) if j != k]
        scored.sort()
        for s, none, i, _, _ in [x for x in scored if x[4] == label][: p.positives]:
            near = [x for x in scored if x[4] != label and p.low * -s <= 100 * -x[0] <= p.high * -s]
            out += [(a, None if none else i, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(near[: p.negatives], 1)]
    return out


def _order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v) for v in r))


def _relabelled(rows):
    return [(i, v, (label + 1) % 10 if label is not None and i is not None and i % 7 == 0 else label) for i, v, label in rows]


def test_query_equals_plain_and_sql(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = _order(N.op13_hard_negatives(spark, SF).collect())
    assert got and got == _order(_plain(_relabelled(rows), lambda a: a % 50 == 0))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == _order(con.execute(N.OP13_SQL).fetchall())


@pytest.mark.parametrize("digit", [3, 10, 30])
@pytest.mark.parametrize("block", [32, 4096])
def test_ties_blocks_and_digits(spark, digit, block):
    """Few distinct vectors, so most scores tie; every split into blocks and digits gives the same."""
    r = np.random.default_rng(digit * 100 + block)
    some = r.normal(0, 0.3, (6, 5)).astype(np.float32)
    rows = [(int(i), some[r.integers(0, 6)].tolist(), int(r.integers(0, 3))) for i in r.permutation(240)]
    p = N.Mining(block=block, digit=digit)
    got = N.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, p)
    assert _order(got.collect()) == _order(_plain(rows, lambda a: a % 10 == 0, p))


def test_odd_rows(spark):
    """Nulls anywhere, values that are not finite, repeated ids, short and empty vectors, few positives, negative and zero scores, clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.25], 1), (None, [0.9, 0.5], 1), (1, None, 1), (2, [0.5, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [0.5, 0.5], None),
        (50, [1.0], 2), (51, [], 2), (52, [0.6, 0.3], 2), (53, [0.6, 0.3], 3), (-50, [-1.0, 0.0], 4), (54, [1.0, 0.0], 4), (55, [-0.5, 0.0], 5), (100, [0.0, 0.0], 6), (56, [1.0, 1.0], 6), (57, [0.0], 7), (None, [0.7, 0.3], 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "q", "w", "v", "a", "anchor", "score"):
        df = df.withColumn(c, F.lit("?"))
    got = N.mine(df, F.col("vec_id") % 50 == 0)
    assert _order(got.collect()) == _order(_plain(rows, lambda a: a % 50 == 0))
    assert N.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert N.mine(df, F.lit(False)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 19])
def test_large_numbers_stay_exact(spark, scale):
    """Scores below 2**24, below 2**53 and above."""
    r = np.random.default_rng(scale)
    rows = [(i, r.normal(0, 20, 4).astype(np.float32).tolist(), i % 2) for i in range(60)]
    p = N.Mining(scale=scale, low=1, high=100)
    assert _order(N.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, p).collect()) == _order(_plain(rows, lambda a: a % 20 == 0, p))


def test_too_large_is_an_error(spark):
    with pytest.raises(ValueError):
        N.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], SCHEMA), F.col("vec_id") == 0)
