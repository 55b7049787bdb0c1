import json

import pytest

from cadenza import config as C
from cadenza.sinks import write_reports
from cadenza.sources.files import read_documents


def test_load_and_snapshot(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"app": {}, "steps": {}, "llm_providers": {"a": {"api_key": "k"}, "b": {"api_key": ""}}}))
    c = C.load(str(p))
    assert C.snapshot(c)["llm_providers"] == {"a": {"api_key": "***REDACTED***"}, "b": {"api_key": ""}} and c["llm_providers"]["a"]["api_key"] == "k"
    p.write_text("{}")
    with pytest.raises(ValueError, match="sections"):
        C.load(str(p))


def test_skips(tmp_path):
    p = tmp_path / "x"
    assert not C.there([str(p)]) and not C.unchanged(str(p), 1, 0)
    p.write_text("a")
    s = p.stat()
    assert C.there([str(p)]) and not C.there([str(p)], overwrite=True) and not C.there([])
    assert C.unchanged(str(p), 1, s.st_mtime) and not C.unchanged(str(p), 2, s.st_mtime)


def test_reports(spark, tmp_path):
    write_reports(spark.createDataFrame([(1, ["a"])], "id int, issues array<string>"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["issues"] == ["a"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{\n "x": 1,\n "y": {"z": "q"}\n}')
    r = read_documents(spark, str(tmp_path / "d"), "x int, y struct<z: string>, w string").first()
    assert (r.x, r.y.z, r.w) == (1, "q", None)
