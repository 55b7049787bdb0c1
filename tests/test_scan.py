"""Scans over parts against loops over whole tracks."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import cues as Q
from cadenza.operators import scan
from tests.test_cues import cascade

SCHEMA = "video_id string, ord long, index long, start_ms long, end_ms long, text string"


@pytest.fixture
def small_parts(monkeypatch):
    """Parts of four rows."""
    monkeypatch.setattr(scan, "BITS", 2)


def _tracks(spark, seed, tracks=6, most=60, short=-200):
    r = random.Random(seed)
    data = {}
    for v in range(tracks):
        at, items = 0, []
        for _ in range(r.randint(0, most)):
            at += r.choice([0, 1, 50, 400, 900, 3000])
            items.append((at, at + r.choice([short, 0, 100, 799, 800, 801, 2000, 9000]), r.choice("ab")))
        data[str(v) if v else None] = sorted(items)
    # Places with holes, as after a filter.
    rows = [(v, i * (1 + n % 3), 0, *x) for n, (v, items) in enumerate(data.items()) for i, x in enumerate(items, 1)]
    r.shuffle(rows)
    return data, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", range(6))
def test_separated_over_parts(spark, small_parts, seed):
    data, df = _tracks(spark, seed, short=-200 if seed % 2 else 100)
    merge = seed % 3 > 0
    want = [(v, n, *x) for v, items in data.items() for n, x in enumerate(cascade(items, merge=merge), 1)]
    got = Q.separated(df, Q.Clean(merge_short=merge)).collect()
    key = lambda x: (x[0] is not None, x)
    assert sorted(((r.video_id, r.ord, r.start_ms, r.end_ms, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r["index"] == r.ord for r in got)


def test_running_over_parts(spark, small_parts):
    data, df = _tracks(spark, 11)
    df = df.withColumn("x", F.when(F.col("ord") % 5 != 0, F.col("end_ms")))
    out = scan.running(df, ("video_id",), n=("sum", F.lit(1).cast("long")), s=("sum", F.col("x")), m=("max", F.col("x")), p=("last", F.col("x")))
    before = {}
    for r in sorted(out.collect(), key=lambda r: r.ord):
        seen = before.setdefault(r.video_id, [])
        known = [x for x in seen if x is not None]
        assert (r.n, r.s, r.m) == (len(seen), sum(known), max(known, default=None))
        assert (r.p is None) == (not seen) and (not seen or r.p.v == seen[-1])
        seen.append(r.x)
    assert sum(map(len, before.values())) == sum(map(len, data.values()))


def test_runs_over_parts(spark, small_parts):
    _, df = _tracks(spark, 12)
    df = df.withColumn("k", F.when(F.col("start_ms") % 3 != 0, F.lit("x")))
    last, run = {}, {}
    for r in sorted(scan.runs(df, ("video_id",), F.col("k")).collect(), key=lambda r: r.ord):
        v = r.video_id
        if v not in last or last[v] != r.k:
            run[v] = run.get(v, 0) + 1
        last[v] = r.k
        assert r.run == run[v]


def test_repeats_errors_and_numbers_over_parts(spark, small_parts):
    """The operators built on scans give what one part gives."""
    _, df = _tracks(spark, 13, most=90)
    df = df.withColumn("text", F.when(F.col("ord") % 40 < 20, "same").otherwise(F.col("text")))
    work = [lambda: Q.without_repeats(df, Q.Clean(repeat_span_ms=100)), lambda: Q.errors(df), lambda: Q.renumber(df), lambda: Q.cleaned(df.withColumn("seen", F.lit(900)), visual_start="seen")]
    split = [sorted(map(str, f().collect())) for f in work]
    scan.BITS = 40
    assert split == [sorted(map(str, f().collect())) for f in work]


def test_no_times_move_nothing(spark, small_parts):
    rows = [("v", i, i, *x) for i, x in enumerate([(0, 5000, "a"), (None, 9, "b"), (7, None, "c"), (100, 200, "d"), (None, None, "e"), (150, 900, "f")], 1)]
    got = Q.separated(spark.createDataFrame(rows, SCHEMA)).orderBy("ord").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 5000), (None, 9), (7, None), (5001, 5801), (None, None), (5802, 6602)]


def test_empty_and_part_sized(spark, small_parts):
    assert Q.separated(spark.createDataFrame([], SCHEMA)).count() == 0
    for n in (3, 4, 5, 8, 9):
        df = spark.range(1, n + 1).select(F.lit("v").alias("video_id"), F.col("id").alias("ord"), F.col("id").alias("index"), F.lit(0).cast("long").alias("start_ms"), F.lit(800).cast("long").alias("end_ms"), F.lit("x").alias("text"))
        assert [r.start_ms for r in Q.separated(df).orderBy("ord").collect()] == [801 * i for i in range(n)]


def test_a_long_track_goes_over_many_tasks(spark):
    """No window and no exchange by the track alone; every cue overlaps the one before."""
    n = 400_000
    df = spark.range(1, n + 1, numPartitions=8).select(F.lit("v").alias("video_id"), F.col("id").alias("ord"), F.col("id").alias("index"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 900).alias("end_ms"), F.lit("x").alias("text"))
    tall = scan.deoverlapped(df, ("video_id",), 800, True)
    plan = tall._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.splitlines() if "Window [" in x]
    assert rows and all("_part" in x for x in rows)
    got = tall.select(F.max("end_ms").alias("e"), F.count("*").alias("n"), F.count_if(F.col("start_ms") == 10 + (F.col("ord") - 1) * 801 + F.when(F.col("ord") > 1, 100).otherwise(0)).alias("right")).first()
    assert got.n == n and got.right == n and got.e == 910 + (n - 1) * 801
