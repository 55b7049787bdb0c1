import json

import pytest

from cadenza.llm.chat import OP4_SQL, Tools, levels, link, op4_tool_calls

TOOLS = Tools({"f": {"a": ("integer", True), "b": ("string", False), "after": ("array", False)}})
CALLS = "conv_id long, seq long, call_id string, name string, arguments string"
RESULTS = "conv_id long, seq long, call_id string, content string"


def run(spark, calls, results, tools=TOOLS):
    out = link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), tools)
    return sorted(((r.conv_id, r.call_id, r.status, r.level, r.position, r.errors) for r in out.collect()), key=str), out


def test_statuses(spark):
    calls = [
        (1, 0, "x", "f", '{"b": "q", "a": 1}'),
        (1, 1, "y", "f", '{"a": 2.5, "after": ["x"]}'),
        (1, 2, "z", "g", "{}"),
        (1, 3, "x", "f", '{"a": 9}'),
        (1, 4, "w", "f", "no json"),
        (1, 5, "c", "f", '{"a": 1, "after": ["d"]}'),
        (1, 6, "d", "f", '{"a": 1, "after": ["c"]}'),
        (1, 7, "e", "f", '{"a": 1, "zz": 0, "after": ["gone"]}'),
        (2, 0, "x", "f", "[1]"),
        (None, 0, "x", "f", '{"a": 1}'),
        (2, 1, None, "f", '{"a": 1}'),
    ]
    results = [(1, 9, i, "r") for i in ("x", "y", "z", "w", "c", "d", "e", "lost", "x")] + [(None, 1, "x", "r")]
    got, _ = run(spark, calls, results)
    want = [
        (1, "x", "ok", 0, 1, ""),
        (1, "y", "invalid", 1, 5, "type:a"),
        (1, "z", "invalid", 0, 2, "unknown_function"),
        (1, "x", "repeated", None, None, ""),
        (1, "w", "invalid", 0, 3, "not_json"),
        (1, "c", "cycle", None, None, ""),
        (1, "d", "cycle", None, None, ""),
        (1, "e", "invalid", 0, 4, "unknown:zz,dangling"),
        (2, "x", "pending", 0, 1, "not_object"),
        (None, "x", "pending", None, None, ""),
        (2, None, "pending", None, None, ""),
        (1, "lost", "orphan", None, None, ""),
        (1, "x", "orphan", None, None, ""),
        (None, "x", "orphan", None, None, ""),
    ]
    assert got == sorted(want, key=str)


def test_canonical_json(spark):
    _, out = run(spark, [(1, 0, "x", "f", '{"b": "é\\n", "a" : 1.0e0, "after": []}')], [(1, 1, "x", None)])
    text = out.first().canonical
    assert text.startswith('{"arguments":{"a":1') and " " not in text and '"result":null' in text
    assert list(json.loads(text)) == sorted(json.loads(text))


def test_equal_rows_are_told_apart(spark):
    row, res = (1, 0, "x", "f", '{"a": 1}'), (1, 1, "x", "r")
    got, _ = run(spark, [row, row, row], [res, res])
    assert [g[2] for g in got].count("ok") == 1 and [g[2] for g in got].count("repeated") == 2 and [g[2] for g in got].count("orphan") == 1


def test_empty_and_null(spark):
    assert run(spark, [], [])[0] == []
    got, _ = run(spark, [(1, None, "x", None, None)], [])
    assert got == [(1, "x", "pending", 0, 1, "not_json")]


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    calls = spark.createDataFrame([(1, 0, "x", "f", '{"a": 1}')], CALLS)
    results = spark.createDataFrame([(1, 1, "x", "r")], RESULTS)
    for c in ("k", "level", "parsed", "first", "position", "status"):
        calls, results = calls.withColumn(c, F.lit("?")), results.withColumn(c, F.lit("?"))
    assert link(calls, results, TOOLS).first().status == "ok"


def test_levels_of_a_long_chain_and_a_diamond(spark):
    n = 8
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)] + [("p",), ("q",), ("l",), ("r",)], "k string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, n)] + [("l", "p"), ("r", "p"), ("q", "l"), ("q", "r"), ("q", "p")], "k string, parent string")
    got = {r.k: r.level for r in levels(nodes, edges).collect()}
    assert got == {**{f"n{i}": i for i in range(n)}, "p": 0, "l": 1, "r": 1, "q": 2}


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    rel = c.sql(OP4_SQL)
    names, want = rel.columns, rel.fetchall()
    got = [tuple(r[k] for k in names) for r in op4_tool_calls(spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
