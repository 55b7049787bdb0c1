"""Cue operators on literal rows, and the cascade against a row-at-a-time version."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza import sinks as K
from cadenza.functions import text as T
from cadenza.functions import timecode as C
from cadenza.operators import align as A
from cadenza.operators import cues as Q
from cadenza.operators import sampling as S
from cadenza.sources import subtitles as R

SCHEMA = "video_id string, ord long, index long, start_ms long, end_ms long, text string"


def track(spark, rows, video="v"):
    return spark.createDataFrame([(video, i, i, a, b, t) for i, (a, b, t) in enumerate(rows, 1)], SCHEMA)


def rows(df):
    return [(r.start_ms, r.end_ms, r.text) for r in df.orderBy("video_id", "ord").collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_parse_and_format(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\n你好\n\n2\n00:00:02,100 --> 00:00:03,000\n再见\n"
    cues = R.parse_srt(spark.createDataFrame([("a", text)], "video_id string, text string"))
    assert rows(cues) == [(1000, 2000, "你好"), (2100, 3000, "再见")]
    assert Q.errors(cues).count() == 0
    assert "00:00:01,000 --> 00:00:02,000" in K.srt(cues).first().content


@pytest.mark.parametrize(
    "text,expected",
    [
        ("﻿1\r\n00:00:01,000 --> 00:00:02,000\r\na\r\n \r\n2\r\n00:00:03,000 --> 00:00:04,000 X1\r\nb \r\n c\r\n", [(1, "a"), (2, "b\n c")]),
        ("x\n00:00:01,000 --> 00:00:02,000\na\n\nno\ntime\nz\n\ny\n00:00:03,000 --> 00:00:04,000\nb", [(1, "a"), (2, "b")]),
        ("7\n00:00:01,000 --> 00:00:02,000", []),
        ("", []),
        ("5\r00:00:01,000 --> 00:00:02,000\ra\r", [(5, "a")]),
    ],
)
def test_parse_edges(spark, text, expected):
    cues = R.parse_srt(spark.createDataFrame([("a", text)], "video_id string, text string"))
    assert [(r["index"], r.text) for r in cues.orderBy("ord").collect()] == expected


def test_times(spark):
    r = one(spark, C.ass_time(F.lit(1234)), C.ass_time(F.lit(5)), C.ass_time(F.lit(15)), C.ass_time(F.lit(25)), C.ass_time(F.lit(-5)), C.srt_time(F.lit(360000000)), C.srt_time(F.lit(-1)), C.srt_ms(F.lit("01:02:03,004")), C.srt_ms(F.lit("100:00:00,000")))
    assert list(r) == ["0:00:01.23", "0:00:00.00", "0:00:00.02", "0:00:00.02", "0:00:00.00", "100:00:00,000", "00:00:00,000", 3723004, None]


def test_escape(spark):
    assert one(spark, T.ass_escape(F.lit("a\nb{c}")))[0] == r"a\Nb\{c\}"


def cascade(items, lo=800, merge=True):
    out = []
    for a, b, t in items:
        if out and a < out[-1][1]:
            a = out[-1][1] + 1
            b = max(b, a + lo)
        if out and merge and b - a < lo:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + t)
            continue
        out.append((a, b, t))
    return out


def test_exact_touch(spark):
    c = Q.clamped(track(spark, [(0, 100, "a"), (800, 900, "b")]))
    assert rows(Q.separated(c)) == [(0, 800, "a"), (800, 1600, "b")]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 9000), st.integers(-200, 4000)), max_size=25), max_size=4), st.booleans())
def test_cascade(spark, tracks, merge):
    data, want = [], []
    for v, items in enumerate(tracks):
        items = sorted((a, a + n, chr(97 + i % 26)) for i, (a, n) in enumerate(items))
        data += [(str(v), i, i, *x) for i, x in enumerate(items, 1)]
        want += [(str(v), *x) for x in cascade(items, merge=merge)]
    df = spark.createDataFrame(data, SCHEMA)
    got = Q.separated(df, Q.Clean(merge_short=merge))
    assert [(r.video_id, r.start_ms, r.end_ms, r.text) for r in got.orderBy("video_id", "ord").collect()] == want


def test_repeats(spark):
    same = [(i * 1000, i * 1000 + 900, "好。") for i in range(4)]
    assert rows(Q.without_repeats(track(spark, [(0, 900, "好！")] + [(a + 1000, b + 1000, t) for a, b, t in same]))) == []
    assert len(rows(Q.without_repeats(track(spark, same)))) == 4  # spans 3900 ms only
    assert len(rows(Q.without_repeats(track(spark, [(i * 2000, i * 2000 + 900, "。") for i in range(6)])))) == 6


def test_bridged(spark):
    c = spark.createDataFrame([("v", 1, 0, 10), ("v", 2, 5, 8), ("v", 3, 12, 20), ("v", 4, 25, 26)], "video_id string, ord long, start long, end long")
    assert [(r.start, r.end) for r in Q.bridged(c, 4).orderBy("run").collect()] == [(0, 20), (25, 26)]


def test_errors_in_order(spark):
    c = spark.createDataFrame([("v", 1, 2, 5, 5, " "), ("v", 2, 2, 3, 9, "x")], SCHEMA)
    t = spark.createDataFrame([("v",), ("w",)], "video_id string")
    got = [r.message for r in Q.errors(c, t).orderBy("video_id", "ord", "check_no").collect()]
    assert got == ["index 2 should be 1", "index 1 has empty text", "index 1 start time is not before end time", "index 2 overlaps previous subtitle", "subtitle file has no valid items"]


def test_alignment(spark):
    src = track(spark, [(0, 1, "a"), (2, 3, "b"), (4, 5, "c"), (6, 7, "d")])
    other = spark.createDataFrame([("v", 1, 1, 0, 0, "one"), ("v", 2, 1, 0, 0, ""), ("v", 3, 9, 0, 0, " nine ")], SCHEMA)
    got = [(r.text, r.matched) for r in A.aligned(src, other).orderBy("ord").collect()]
    assert got == [("", "index"), ("", "position"), ("nine", "position"), (None, None)]
    with pytest.raises(Exception, match="Missing translation for subtitle index 4"):
        A.strict(A.aligned(src, other)).collect()


@pytest.mark.parametrize("text,lines", [("", [""]), ("  ", ["  "]), ("a" * 50, ["a" * 50]), ("x" * 21 + " " + "y" * 20, ["x" * 21 + " " + "y" * 20]), ("x" * 21 + " " + "y" * 21, ["x" * 21, "y" * 21]), ("a " + "b" * 50 + " c", ["a", "b" * 50, "c"])])
def test_wrap(spark, text, lines):
    assert one(spark, T.wrap(F.lit(text)))[0] == lines


def test_rebalance(spark):
    word = "w" * 40
    r = one(spark, T.rebalance(F.lit(f"{word} {word} {word}")), T.rebalance(F.lit(" ".join([word] * 5))), T.rebalance(F.lit("a\nb")))
    assert list(r) == [f"{word}\n{word} {word}", f"{word} {word}\n{word} {word} {word}", "a\nb"]


def test_unicode_space(spark):
    assert one(spark, T.strip(F.lit("　 \xa0x　")), T.is_blank(F.lit("　\n")))[0:2] == ("x", True)


def test_samplers(spark):
    c = track(spark, [(0, 1000, "a"), (1000, 2000, "b"), (2200, 3000, "c"), (9000, 9900, "d")]).withColumn("t", F.lit(10.0))
    keys = ("video_id", "t")
    assert S.near_centre(c, "t", 2, 1.0, keys=keys).first().seconds == [1.5, 2.6]
    assert S.near_centre(c, "t", 3, 100.0, fill=True, keys=keys).first().seconds == [1.5, 2.6, 9.45]
    assert [r.ord for r in S.strided(c, 2).orderBy("ord").collect()] == [1, 3]
    row = c.select(*(S.shares(F.lit(1.0), n, how).alias(f"{how}{n}") for how in ("even", "middle_nearby") for n in (1, 2, 3, 5, 6))).first()
    assert row["middle_nearby5"] == [0.3333333333333333, 0.45, 0.5, 0.55, 0.6666666666666666] and row["middle_nearby6"] == [0.25, 0.45, 0.5, 0.55, 0.75]
    assert (row["middle_nearby1"], row["middle_nearby2"], row["middle_nearby3"]) == ([0.5], [0.45, 0.5], [0.45, 0.5, 0.55])
    assert row["even3"] == [0.1, 0.5, 0.9] and row["even1"] == [0.5] and row["even5"] == [k / 6 for k in range(1, 6)]
    spread = [c.repartition(n).select(S.scattered(F.lit(60.0), 4, 7).alias("s")).first().s for n in (1, 3)]
    assert spread[0] == spread[1] == sorted(spread[0]) and 4.8 <= spread[0][0] <= spread[0][-1] <= 55.2


def test_quality_of_order_not_extremes(spark):
    c = track(spark, [(5000, 6000, "a"), (100, 200, "b")])
    r = Q.quality(c).first()
    assert (r.first_start_ms, r.last_end_ms, r.passed, r.short_item_count) == (5000, 200, True, 1)


def test_positive_visual_filter_fails(spark):
    c = track(spark, [(0, 1000, "a"), (2000, 3000, "b")])
    seen = spark.createDataFrame([("v", 1, True)], "video_id string, ord long, visible boolean")
    with pytest.raises(Exception, match="no visible text"):
        Q.visual_filter(c, seen).collect()
    assert len(rows(Q.visual_filter(c, seen, fail=False))) == 2


def test_stream(spark, tmp_path):
    from cadenza.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "hi"


def test_read_and_write_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("﻿1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    cues = R.read_srt(spark, str(tmp_path / "in"))
    assert rows(cues) == [(1000, 2000, "hi")]
    K.write_texts(K.srt(cues.withColumn("video_id", F.lit("a"))), str(tmp_path / "out"))
    written = list((tmp_path / "out").rglob("*.txt"))
    assert [p.read_text() for p in written] == ["1\n00:00:01,000 --> 00:00:02,000\nhi\n"]


def nearest(cues, seconds, n, interval, clamp, fill):
    """The sampler row by row."""
    rows = sorted((c for c in cues if c[1] > c[0]), key=lambda c: abs((c[0] + c[1]) / 2 - seconds * 500))
    out = []
    for a, b in rows:
        m = (a + b) / 2 / 1000
        if clamp:
            m = max(a / 1000 + 0.05, min(b / 1000 - 0.05, m))
        else:
            m = round(max(0, min(seconds, m)), 3)
        if len(out) < n and all(abs(m - x) >= interval for x in out):
            out.append(round(max(0, min(seconds, m)), 3))
    for a, b in rows if fill else []:
        m = round(max(0, min(seconds, (a + b) / 2 / 1000)), 3)
        if len(out) < n and m not in out:
            out.append(m)
    return sorted(out)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30_000), st.integers(-2, 2000)), min_size=1, max_size=15), st.sampled_from([0.5, 1.0, 4.0]), st.booleans(), st.booleans())
def test_near_centre(spark, items, interval, clamp, fill):
    items = [(2 * a, 2 * (a + n)) for a, n in items]  # whole middles: no ties at the third place
    c = track(spark, [(a, b, "x") for a, b in items]).withColumn("t", F.lit(50.0))
    got = S.near_centre(c, "t", 4, interval, clamp=clamp, fill=fill, keys=("video_id", "t")).first()
    assert (got.seconds if got else []) == nearest(items, 50.0, 4, interval, clamp, fill)
