"""Levels of long chains in few rounds, whatever the order of the calls."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import chat
from cadenza.llm.chat import levels


def longest(nodes, edges):
    """Levels by taking off what waits for nothing."""
    wait, after, out = {k: 0 for k in nodes}, {}, {}
    for k, p in edges:
        wait[k] += 1
        after.setdefault(p, []).append(k)
    ready = [k for k, n in wait.items() if not n]
    out = dict.fromkeys(ready, 0)
    while ready:
        p = ready.pop()
        for k in after.get(p, ()):
            out[k] = max(out.get(k, 0), out[p] + 1)
            wait[k] -= 1
            if not wait[k]:
                ready.append(k)
    return {k: v for k, v in out.items() if not wait[k]}


@pytest.fixture
def rounds(monkeypatch):
    seen = []
    whole = chat.written
    monkeypatch.setattr(chat, "written", lambda df, name: (seen.append(name), whole(df, name))[1])
    return seen


def test_a_chain_of_ten_thousand(spark, rounds):
    n = 10_000
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("k"), F.lit("c").alias("conv"), F.col("id").alias("seq"))
    edges = spark.range(1, n).select(F.concat(F.lit("n"), "id").alias("k"), F.concat(F.lit("n"), F.col("id") - 1).alias("parent"))
    out = levels(nodes, edges).where(F.col("k") == F.concat(F.lit("n"), "level"))
    assert out.count() == n and rounds.count("round") <= 10


def test_a_chain_against_the_order_and_calls_of_one_instant(spark, rounds):
    n = 600
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("k"), F.lit("c").alias("conv"), (n - F.col("id")).alias("seq"))
    edges = spark.range(1, n).select(F.concat(F.lit("n"), "id").alias("k"), F.concat(F.lit("n"), F.col("id") - 1).alias("parent"))
    assert levels(nodes, edges).where(F.col("k") == F.concat(F.lit("n"), "level")).count() == n
    assert rounds.count("round") == 1
    wide = levels(nodes.withColumn("seq", F.lit(5).cast("long")), edges.limit(0), stretch=64)
    assert wide.where("level = 0").count() == n


@pytest.mark.parametrize("stretch", [3, 10, 1000])
def test_random_graphs(spark, stretch):
    rng = random.Random(stretch)
    names = [(f"n{i}", f"c{i % 2}", rng.choice([None, rng.randint(0, 40)])) for i in range(60)]
    edges = {(f"n{b}", f"n{a}") for a, b in (rng.sample(range(i, 60, 2), 2) for i in rng.choices((0, 1), k=50)) if a < b or rng.random() < 0.05}
    nodes = spark.createDataFrame(names, "k string, conv string, seq long")
    got = {r.k: r.level for r in levels(nodes, spark.createDataFrame(sorted(edges), "k string, parent string"), stretch).collect()}
    assert got == longest([k for k, _, _ in names], edges)


def test_nested_schemas(spark):
    from cadenza.llm.chat import Tools

    from .test_chat import run

    tools = Tools({"f": {"n": ("integer", True), "unit": ("string", False, ["C", "F"]), "place": ("object", True, {"lat": ("number", True), "tags": ("array", False, ("string",))}), "steps": ("array", False, ("object", {"id": ("integer", True)}))}})
    cases = {
        "a": ('{"n": 1.0, "place": {"lat": 1}}', ""),
        "b": ('{"n": 1.5, "unit": "K", "place": {"lat": "x", "more": 1}}', "type:n,type:place.lat,unknown:place.more,value:unit"),
        "c": ('{"n": 2, "unit": "C", "place": {"lat": 0.5, "tags": ["x", 1]}, "steps": [{"id": 1}, {}, 3, {}]}', "missing:steps[].id,type:place.tags[],type:steps[]"),
        "d": ('{"n": 2, "place": [1]}', "type:place"),
    }
    got, _ = run(spark, [(1, k, i, "f", text) for k, (i, (text, _)) in enumerate(cases.items())], [], tools)
    assert {i: e for _, i, _, _, _, e in got} == {i: e for i, (_, e) in cases.items()}
