import hashlib
import random
import re

import duckdb
import numpy as np

from cadenza.llm.exact_dedup import OP2_SQL, exact_duplicates, op2_exact_dedup
from cadenza.llm.graph import components
from cadenza.llm.near_dedup import NearDedup, bounds, near_duplicates

from .conftest import ODD, SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^ \t-\r]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    """Component of every id by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, families, most):
    """Families of texts whose members differ in a few words, some of them by much."""
    rng = random.Random(seed)
    out, i = {}, 0
    for _ in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 6))):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 9)}"
            out[i] = " ".join(t)
            i += 1
    return out


def check_near(spark, texts, p=NearDedup()):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, p).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(texts).items()}


def test_near_against_all_pairs(spark):
    check_near(spark, copies(1, 30, 8))


def test_near_in_many_blocks(spark):
    """One family over several blocks: links between blocks have to be found."""
    check_near(spark, copies(2, 3, 70), NearDedup(block=16))


def test_near_in_blocks_of_few_documents_and_bytes(spark):
    """Buckets wider than a few blocks lose no link either."""
    check_near(spark, copies(2, 3, 70), NearDedup(block=8))
    check_near(spark, copies(2, 3, 70), NearDedup(block_bytes=4000))


def test_near_of_the_tables(spark, documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents).collect()}
    assert got == brute(texts)


def test_near_odd_cases(spark, odd, nothing):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert by[1, 0] == (1, True) and by[2, 0] == (2, True) and by[3, 0] == (3, True)
    assert by[4, 1] == (-3, False) and by[5, 1] == (-3, False) and by[-3, 1] == (-3, True)
    assert by[7, 3] == (6, False) and by[None, 3] == (None, True) and by[None, 0] == (None, True)
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert near_duplicates(nothing).count() == 0


def test_bounds_keep_what_is_similar_enough():
    """A pair of similarity t falls under a bound with little more than the miss probability."""
    rng = np.random.default_rng(0)
    p = NearDedup()
    for n, m in bounds(p):
        assert (rng.binomial(n, p.percent / 100, 100_000) < m).mean() < 1e-3
    assert bounds(p)[-1][1] > 0.6 * p.hashes


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = c.sql(OP2_SQL)
    names, want = rel.columns, rel.fetchall()
    assert sorted(tuple(r[n] for n in names) for r in op2_exact_dedup(spark, SF).collect()) == sorted(want)


def test_exact_odd_cases(spark, odd, nothing):
    rows = exact_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept, r.text_sha256))
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1] == [(3, 4, False, empty)] and by[3] == [(3, 4, True, empty)] and by[2][0][:3] == (3, 4, False)
    assert [x[:3] for x in by[5]] == [(5, 2, True)] * 2 and by[4][0][:3] == (-3, 2, False) and by[-3][0][:3] == (-3, 2, True)
    assert by[6][0][:3] == (6, 3, True) and by[7][0][:3] == (6, 3, False)
    assert sorted(x[0] for x in by[None]) == [3, 6] and not any(x[2] for x in by[None])
    assert exact_duplicates(nothing).count() == 0


def test_exact_keeps_colliding_texts_apart(spark, monkeypatch):
    """With one hash for all texts the bytes alone decide."""
    from pyspark.sql import functions as F

    from cadenza.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "_hash128", lambda text: F.unhex(F.lit("00" * 16)))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(df).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_exact_runs_no_python(documents):
    plan = exact_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
