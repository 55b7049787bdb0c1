"""Replaced folders, manifests, calls in rounds, hashes of rows, frame pairs."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import sinks as K
from cadenza.operators import calls as C
from cadenza.operators import manifest as M
from cadenza.operators import pixels as X
from cadenza.operators import runs as R
from cadenza.plans import catalog

D = "/root/testdata/sf0.001"


def _rows(spark, path):
    return sorted(r.id for r in spark.read.schema("id long").json(path).collect())


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    path = f"file://{tmp_path}/out/report"
    K.write_reports(spark.range(3), path)

    def half(to):
        spark.range(2).write.json(to)
        raise OSError("full")

    with pytest.raises(OSError):
        K.replace(spark, path, half)
    assert _rows(spark, path) == [0, 1, 2] and os.listdir(tmp_path / "out") == ["report"]
    # A job that fails in a task.
    bad = spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        K.write_reports(bad, path)
    assert _rows(spark, path) == [0, 1, 2] and os.listdir(tmp_path / "out") == ["report"]
    K.write_reports(spark.range(5, 7), path)
    assert _rows(spark, path) == [5, 6] and os.listdir(tmp_path / "out") == ["report"]


def test_an_exchange_cut_short_is_put_right(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    K.write_reports(spark.range(3), path)
    os.rename(tmp_path / "report", tmp_path / ".report.old")  # as if the process ended between the renames

    def no(to):
        raise OSError("full")

    with pytest.raises(OSError):
        K.replace(spark, path, no)
    assert _rows(spark, path) == [0, 1, 2]


def test_renames_are_tried_again_and_undone(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/report"
    K.write_reports(spark.range(3), path)
    waits = []

    def gone(to):  # the new folder is missing, so its rename fails every time
        pass

    with pytest.raises(Exception):  # noqa: B017, PT011  whichever the file system raises
        K.replace(spark, path, gone, sleep=waits.append)
    assert _rows(spark, path) == [0, 1, 2] and waits in ([], [0.4, 0.8, pytest.approx(1.2), 1.6])


INPUTS = "name string, size long, modified long, hash string"


def test_only_what_changed_is_done_again(spark, tmp_path):
    path, asked = f"file://{tmp_path}/runs", []

    def work(todo):
        asked.append(sorted(r.name for r in todo.select("name").collect()))
        return todo.select("name", F.length("name").alias("n"), F.lit(len(asked)).alias("pass"))

    def run(rows, **more):
        asked.clear()
        n = M.run(spark.createDataFrame(rows, INPUTS), path, work, **more)
        return n, asked[0] if asked else None, sorted((r.name, r.made) for r in M.outputs(spark, path).collect())

    one = [("a", 1, 10, "x"), ("b", 2, 10, None), ("c", 3, 10, None)]
    assert run(one) == (1, ["a", "b", "c"], [("a", 1), ("b", 1), ("c", 1)])
    assert run(one) == (1, None, [("a", 1), ("b", 1), ("c", 1)])
    # Another time with the same content, another size, one gone, one new.
    two = [("a", 1, 11, "x"), ("b", 9, 10, None), ("d", 4, 10, "z")]
    assert run(two) == (2, ["b", "d"], [("a", 1), ("b", 2), ("d", 2)])
    assert run([("a", 1, 11, "y"), *two[1:]]) == (3, ["a"], [("a", 3), ("b", 2), ("d", 2)])
    assert run(two[:2]) == (4, ["a"], [("a", 4), ("b", 2)])
    assert run(two[1:2]) == (5, [], [("b", 2)])
    assert run(two[1:2], overwrite=True) == (6, ["b"], [("b", 6)])


def test_a_run_that_fails_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    first, second = spark.createDataFrame([("a", 1, 1, "x")], INPUTS), spark.createDataFrame([("a", 1, 1, "y"), ("b", 1, 1, "z")], INPUTS)
    good = lambda todo: todo.select("name", "hash")
    M.run(first, path, good)
    with pytest.raises(Exception, match="no"):
        M.run(second, path, lambda todo: todo.select("name", F.raise_error(F.lit("no")).cast("string").alias("hash")))
    assert [(r.name, r.hash) for r in M.outputs(spark, path).collect()] == [("a", "x")]
    assert M.run(second, path, good) == 2
    assert sorted((r.name, r.hash) for r in M.outputs(spark, path).collect()) == [("a", "y"), ("b", "z")]


def test_calls_go_on_after_a_cut_and_are_counted(spark, tmp_path):
    path, notes = f"file://{tmp_path}/calls", tmp_path / "notes"
    notes.mkdir()

    def flaky(prompt, attempt):
        with open(notes / f"{prompt}-1-{attempt}", "a") as f:
            f.write("x")
        if prompt == "never":
            raise ValueError("bad request")
        if attempt < {"second": 2, "late": 9}.get(prompt, 1):
            raise ValueError("connection reset: timeout")
        return prompt.upper()

    def spare(prompt, attempt):
        with open(notes / f"{prompt}-2-{attempt}", "a") as f:
            f.write("x")
        if prompt == "never":
            raise ValueError("not found either")
        return f"spare {prompt}"

    prompts = spark.createDataFrame([(1, "first"), (2, "second"), (3, "never"), (4, "late"), (5, "first"), (6, None)], "id long, prompt string").coalesce(1)
    waits = []

    def cut(seconds):
        waits.append(seconds)
        if len(waits) == 1:
            raise KeyboardInterrupt

    policy = R.Retry(attempts=3, seconds=2.0, factor=3.0)
    with pytest.raises(KeyboardInterrupt):
        C.answered(prompts, (flaky, spare), path, policy, default="?", sleep=cut)
    got = {r.id: (r.reply, r.provider, r.calls, r.error) for r in C.answered(prompts, (flaky, spare), path, policy, default="?", sleep=waits.append).collect()}
    assert got == {
        1: ("FIRST", 0, 1, None), 5: ("FIRST", 0, 1, None), 2: ("SECOND", 0, 2, "connection reset: timeout"), 3: ("?", None, 2, "not found either"),
        4: ("spare late", 1, 4, "connection reset: timeout"), 6: ("", 0, 1, None),
    }
    assert waits == [2.0, 2.0, 6.0]
    # Each request's calls, once each.
    assert {n: (notes / n).read_text() for n in sorted(os.listdir(notes))} == dict.fromkeys(sorted(["-1-1", "first-1-1", "second-1-1", "second-1-2", "never-1-1", "never-2-1", "late-1-1", "late-1-2", "late-1-3", "late-2-1"]), "x")
    assert C.log(spark, path).count() == 10
    # Nothing is asked twice.
    again = C.answered(prompts, (flaky, spare), path, policy, default="?").count()
    assert again == 6 and C.log(spark, path).count() == 10


def test_hash_of_rows_is_that_of_the_driver(spark):
    cases = [
        ({"b": 1, "a": {"z": [1, {"y": 2, "x": 'é\u0001"/,:'}], "d": 1.5, "f": True, "g": None}, "overwrite": True, "provider": "p", "fallback_provider": "q"}, {"p": {"api_key": "k", "m": "x"}, "q": {"api_key": "", "u": {"b": [], "a": {}}}, "r": {}}, b"hi"),
        ({}, None, None), ({"x": "a, b: c\\", "retry": {"max": 1}}, {}, b""), ({"provider": "p"}, {"p": {"api_key": 0}}, None), ({"provider": 7, "deep": {"overwrite": 1}}, {"7": {}}, None),
    ]
    rows = [(f"s{i}", json.dumps(c), p and json.dumps(p), b) for i, (c, p, b) in enumerate(cases)] + [("bad", "[1", None, None), ("list", "[1]", "3", None), ("null", None, None, None)]
    got = {r.step: r.hash for r in R.step_hashes(spark.createDataFrame(rows, "step string, config string, providers string, prompt binary")).collect()}
    for i, (c, p, b) in enumerate(cases[:4]):
        assert got[f"s{i}"] == R.step_hash(f"s{i}", c, p, b)
    assert got["s4"] == R.step_hash("s4", {"provider": 7, "deep": {"overwrite": 1}}, {"7": {}})
    assert [got[x] for x in ("bad", "list", "null")] == [R.step_hash(x, {}) for x in ("bad", "list", "null")]


def _grown(mask, h, w):
    out = np.zeros_like(mask)
    for y in range(-(h // 2), h // 2 + 1):
        for x in range(-(w // 2), w // 2 + 1):
            out |= np.roll(np.roll(np.pad(mask, 20), y, 0), x, 1)[20:-20, 20:-20]
    return out


def test_added_text_of_all_pairs(spark):
    """Every pair of the query against masks put together from shifts, from the same pixels."""
    from cadenza.plans.frame_queries import frame_pairs
    from tests.test_pixels import plain_labels

    finals, originals = ({r.frame_id: r for r in df.collect()} for df in frame_pairs(spark, D))
    got = {r.frame_id: r for r in catalog.load()[0]["x2_added_text"](spark, D).collect()}
    assert got.keys() == finals.keys() == originals.keys()
    bands = 0
    for k, r in got.items():
        f, o = (X.picture(x[k].pixels, 160, 120) for x in (finals, originals))
        assert r.readable == (k % 10 != 0) == (f is not None)
        if f is None:
            assert r.added_pixels is None
            continue
        changed = X.grey(np.abs(f.astype(int) - o.astype(int)).astype(np.uint8)) > 18
        mask = _grown(X.text_mask(f) & _grown(changed, 5, 9) & ~_grown(X.text_mask(o), 9, 15), 3, 5)
        assert (r.added_pixels, r.n_components) == (mask.sum(), len(plain_labels(mask, True)))
        if r.n_bands:
            bands += 1
            assert 60 < r.y1 < r.y2 < 90
    assert bands > 100


def test_pairs_of_other_sizes_and_nulls(spark):
    rows = [("v", 1, 2, 1, bytes(6)), ("v", 2, None, 1, bytes(6)), ("v", 3, 2, 1, None), ("v", 4, 2, 1, bytes(6)), ("v", 6, 2, 1, bytes(6))]
    schema = "video_id string, frame_id long, frame_width int, frame_height int, pixels binary"
    other = [("v", 1, 1, 2, bytes(6)), ("v", 2, 2, 1, bytes(6)), ("v", 3, 2, 1, bytes(6)), ("v", 4, 2, 1, bytes(6)), ("v", 5, 2, 1, bytes(6))]
    got = {r.frame_id: r for r in X.added(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()}
    assert {k: r.readable for k, r in got.items()} == {1: False, 2: False, 3: False, 4: True} and got[4].added_pixels == 0


@pytest.mark.parametrize("seed", range(2))
def test_states_of_a_stream_are_those_of_a_table(spark, tmp_path, seed):
    """Events split into micro-batches at random, late ones among them."""
    import random

    from cadenza.streaming import states as S

    r, order = random.Random(seed), ["s1", "s2", "s3"]
    events = [(f"v{v}", n, r.choice(order), r.choice(["running", "success", "failed", "failed", "done", "partial", "reset", "success"])) for v in range(40) for n in range(r.randint(1, 14))]
    schema = "video_id string, seq long, step string, status string"
    whole = spark.createDataFrame(events, schema)
    want = sorted(map(str, R.job_states(whole).select("video_id", "status", "last_success_step", "failed_step").collect()))
    assert sorted(map(str, S.live_states(whole, order).collect())) == want
    r.shuffle(events)
    folder, parts = tmp_path / "in", 5
    for k in range(parts):
        spark.createDataFrame(events[k::parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    S.follow(stream, order, f"file://{tmp_path}/out", str(tmp_path / "check"), once=True).awaitTermination()
    assert len([x for x in os.listdir(tmp_path / "out") if x.startswith("batch=")]) >= parts
    assert sorted(map(str, S.current(spark, f"file://{tmp_path}/out").select("video_id", "status", "last_success_step", "failed_step").collect())) == want


def test_the_detector_is_not_asked_after_a_hit(spark, tmp_path):
    from cadenza.operators import sampling as P

    def detect(frame):
        with open(tmp_path / str(frame["video_id"]), "a") as f:
            f.write(f"{frame['second']} ")
        return frame["x"]

    hits = {"a": (2.0, 5.0), "b": (), "c": (0.0,), "d": (13.0,), None: (1.5,)}
    rows = [(v, k / 2, k / 2 in at) for v, at in hits.items() for k in range(28)]
    df = spark.createDataFrame(rows, "video_id string, second double, x boolean").orderBy(F.rand(1))
    got = {r.video_id: r.first_visual_ms for r in P.first_seen_by(df, detect).collect()}
    same = {r.video_id: r.first_visual_ms for r in P.first_seen(df.withColumnRenamed("x", "visible")).collect()}
    assert got == same == {"a": 1800, "b": None, "c": 0, "d": None, None: 1300}
    asked = {f: len((tmp_path / f).read_text().split()) for f in os.listdir(tmp_path)}
    assert asked == {"a": 5, "b": 25, "c": 1, "d": 25, "None": 4}
