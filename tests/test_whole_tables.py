"""Queries without SQL that have to run over whole tables."""

from cadenza.plans import catalog

D = "/root/testdata/sf0.001"


def cheapest(a, b):
    """Cost of the cheapest path from the first to the last cell."""
    row = [0.0] + [float("inf")] * len(b)
    for x in a:
        above, row = row, [float("inf")]
        for j, y in enumerate(b, 1):
            row.append(abs(x - y) + min(above[j - 1], above[j], row[-1]))
    return row[-1]


def test_f40_warp(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()}
    paths = {}
    for r in catalog.load()[0]["f40_warp"](spark, D).collect():
        paths.setdefault(r.pair_id, []).append((r.step, r.i, r.j))
    assert set(paths) == {i for i in vectors if i - 1 in vectors}
    for pair, steps in paths.items():
        a, b = vectors[pair], vectors[pair - 1]
        steps.sort()
        assert steps[0][1:] == (0, 0) and steps[-1][1:] == (len(a) - 1, len(b) - 1)
        if pair % 50 == 1:
            assert abs(sum(abs(a[i] - b[j]) for _, i, j in steps) - cheapest(a, b)) < 1e-4
