import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import geometry as G
from cadenza.functions import text as T
from cadenza.operators import bands as B
from cadenza.operators import runs as R
from cadenza.operators.warp import path
from cadenza.sources.boundary import completed, provided
from cadenza.sources.files import list_videos, probed


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_anchor(spark):
    assert one(spark, G.anchor_bottom(F.lit(829), F.lit(32)), G.anchor_bottom(F.lit(829), F.lit(32), F.lit(6))) == [834, 835]


def boxes(spark, *bs):
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(bs, 1)], "ord long, x1 long, y1 long, x2 long, y2 long, n long")
    return df.select(F.lit("v").alias("video_id"), F.lit(1).alias("frame_id"), "ord", F.lit(720).alias("frame_width"), F.lit(1280).alias("frame_height"), B.box(*map(F.col, ("x1", "y1", "x2", "y2", "n"))).alias("b"))


def test_equal_scores_keep_the_first(spark):
    f = boxes(spark, (200, 800, 520, 840, 5), (200, 800, 520, 840, 5), (200, 800, 500, 840, 5))
    assert B.original_band(f).first().ord == 1
    assert B.english_band(f).first().ord == 1


@pytest.mark.parametrize("n,expected", [(1, 10), (2, 20), (3, 20)])
def test_upper_median(spark, n, expected):
    df = spark.createDataFrame([("v", 10 * i, 0, 100 + i, 5) for i in range(1, n + 1)], "video_id string, x1 long, y1 long, x2 long, y2 long")
    r = B.median_box(df).first()
    assert (r.x1, r.sample_count) == (expected, n)


def test_verdict(spark):
    f = boxes(spark, (100, 700, 600, 740, 9))
    frame = boxes(spark, (100, 760, 600, 800, 9)).select("video_id", "frame_id", "frame_width", "frame_height", F.col("b").alias("e"), F.lit(None).cast(B.BOX).alias("detected"), F.lit(None).cast("boolean").alias("visible"))
    out = B.issues(B.primary(frame, f, f.limit(0)), f).first()
    assert out.passed and out.issues == [] and out.warnings == []
    none = frame.withColumn("e", F.lit(None).cast(B.BOX)).withColumn("primary", F.lit(None).cast(B.BOX))
    assert B.issues(none, f).first().issues == ["new English subtitle not detected"]


def test_final_verdict(spark):
    got = [one(spark, *B.final_verdict(F.lit(r), F.lit(a).cast("boolean"), m)) for r, a, m in ((True, False, False), (True, False, True), (False, True, False), (True, None, False))]
    assert got == [[True, True], [False, False], [False, False], [True, False]]


def test_stop_after_a_skipped_step_goes_on(spark):
    s = spark.createDataFrame([("v", i, f"s{i}", True, False, st, "h", "h") for i, st in ((1, "success"), (2, "success"), (3, "failed"))], "video_id string, ord long, step string, enabled boolean, overwrite boolean, status string, stored_hash string, hash string")
    got = {r.step: r.decision for r in R.decisions(s, R.Plan(stop_after="s2")).collect()}
    assert got == {"s1": "skipped", "s2": "skipped", "s3": "run"}


def test_retry_and_fallback():
    waits, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("HTTP 503")
        return "ok"

    assert R.attempt(work, R.Retry(3, 2.0), sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        R.attempt(lambda: (_ for _ in ()).throw(ValueError("bad key")), R.Retry(3), sleep=waits.append)
    assert R.first_that_works([work, lambda: 1 / 0]) == "ok"
    assert R.first_that_works([lambda: 1 / 0], str) == "division by zero"


def test_policies(spark):
    rows = [(1, {"max_retries": "2"}), (2, {"max_attempts": "0"}), (3, {"max_attempts": "-4", "max_retries": "9"}), (4, None), (5, {"max_retries": None, "backoff_seconds": "0.5", "retry_backoff_multiplier": "3"}), (6, {"max_attempts": "4"})]
    got = R.policies(spark.createDataFrame(rows, "id int, config map<string,string>"))
    assert {r.id: (r.attempts, r.seconds, r.factor) for r in got.collect()} == {1: (3, 2.0, 2.0), 2: (1, 2.0, 2.0), 3: (1, 2.0, 2.0), 4: (1, 2.0, 2.0), 5: (1, 0.5, 3.0), 6: (4, 2.0, 2.0)}
    assert sorted((r.id, r.delay) for r in R.delays(got).collect()) == [(1, 2.0), (1, 4.0), (6, 2.0), (6, 4.0), (6, 8.0)]


def test_job_states(spark):
    events = [(1, 1, "a", "running"), (1, 2, "a", "success"), (1, 3, "b", "running"), (1, 4, "b", "failed"), (2, 1, "a", "failed"), (2, 2, "a", "success"), (3, 1, "a", "failed"), (3, 2, None, "done"), (4, 1, "a", "failed"), (4, 2, None, "reset"), (5, 1, "a", "failed"), (5, 2, "b", "success")]
    got = R.job_states(spark.createDataFrame(events, "video_id int, seq int, step string, status string"))
    assert {r.video_id: (r.status, r.last_success_step, r.failed_step) for r in got.collect()} == {1: ("failed", "a", "b"), 2: ("failed", "a", None), 3: ("success", None, None), 4: ("pending", None, None), 5: ("failed", "b", "a")}
    state = spark.createDataFrame([(1, "a", "success", "h"), (1, "old", "failed", None)], "video_id int, step string, status string, hash string")
    full = R.with_steps(state, spark.createDataFrame([(1,), (2,)], "video_id int"), ["a", "b"])
    assert sorted((r.video_id, r.step, r.status) for r in full.collect()) == [(1, "a", "success"), (1, "b", "pending"), (1, "old", "failed"), (2, "a", "pending"), (2, "b", "pending")]


def test_hash_ignores_force_and_keys():
    a = R.step_hash("s", {"x": 1, "overwrite": True, "provider": "p"}, {"p": {"api_key": "k"}})
    assert a == R.step_hash("s", {"provider": "p", "x": 1, "retry": {}}, {"p": {"api_key": "other"}}) != R.step_hash("s", {"x": 2, "provider": "p"}, {"p": {"api_key": "k"}})


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_warp(small, monkeypatch):
    monkeypatch.setattr("cadenza.operators.warp.SMALL", small)

    def plain(x):
        n, m = x.shape
        c = np.full((n + 1, m + 1), np.inf)
        c[0, 0] = 0
        back = {}
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                d, u, left = c[i - 1, j - 1], c[i - 1, j], c[i, j - 1]
                back[i, j] = (i - 1, j - 1) if d < min(u, left) else (i - 1, j) if u < min(d, left) else (i, j - 1)
                c[i, j] = x[i - 1, j - 1] + min(d, u, left)
        out, at = [], (n, m)
        while at != (0, 0):
            out.append((at[0] - 1, at[1] - 1))
            at = back[at]
        return out[::-1]

    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.random((rng.integers(1, 7), rng.integers(1, 7)))
        assert [(int(i), int(j)) for i, j in path(x)] == plain(x)


def test_clamp_int(spark):
    got = one(spark, *(T.clamp_int(F.lit(v), F.lit(2), F.lit(9)) for v in ("3.7", " 5 ", "x", "100")), T.clamp_int(F.lit(3.7), F.lit(2), F.lit(9), numeric=True))
    assert got == [2, 5, 2, 9, 3]


def test_move_text(spark):
    got = one(spark, *(G.move_text(F.lit(t), F.lit(d).cast("long"), F.lit(640), F.lit(900)) for t, d in ((r"a\pos(360,800.5)b\pos(1,2)", 10), ("plain", 5), (r"\pos(1,700)", None), (r"\pos(1,700)", 400))))
    assert got == [r"a\pos(360,810)b\pos(1,2)", "plain", r"\pos(1,700)", r"\pos(1,900)"]


def test_boundaries(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, prompt string")
    words = provided(rows, lambda r: [{"id": r["id"], "w": w} for w in r["prompt"].split()], "id long, w string")
    assert sorted((r.id, r.w) for r in words.collect()) == [(1, "a"), (1, "b"), (2, "c")]

    def model(p):
        if p == "c":
            raise ValueError("busy")
        return p.upper()

    got = sorted((r.reply, r.error) for r in completed(rows, model, lambda p: "spare").collect())
    assert got == [("A B", None), ("spare", "busy")]


def test_listing_and_probe(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in list_videos(spark, str(tmp_path)).collect()] == ["a.mkv", "b.MP4"]
    assert list_videos(spark, str(tmp_path / "none")).count() == 0
    schema = "filename string, duration double, size long, streams array<struct<codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string>>"
    v, a = ("video", "h264", 720, 1280, "30000/1001"), ("audio", "aac", None, None, None)
    df = spark.createDataFrame([("x.mp4", 10.0, 5, [a, v]), ("y.mp4", 9999.0, 5, [a, v]), ("z.mp4", 1.0, 5, [v])], schema)
    assert [(r.filename, r.fps) for r in probed(df).collect()] == [("x.mp4", 29.97)]
