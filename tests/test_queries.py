"""Every registered query of the core against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cadenza.plans import catalog

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_module_without_the_llm_folder(monkeypatch):
    """The rest has to import and list its queries when the subpackage is gone."""
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *a, **k):
        if name.startswith(("cadenza.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith(("cadenza.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    e = importlib.import_module("__spark_entry__")
    assert "a1_quality_report" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    sys.modules.pop("__spark_entry__")
