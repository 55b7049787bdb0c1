"""Where floats, line ends or marks could part a query from its SQL."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import bands as B
from cadenza.operators import sampling as S

FRAME = "0 AS video_id, 0 AS frame_id, 720L AS frame_width, 1280L AS frame_height"


def bands(spark, rows):
    tall = spark.createDataFrame(rows, "ord long, x1 long, y1 long, x2 long, y2 long, n long")
    return tall.selectExpr(*FRAME.split(", "), "*").withColumn("b", B.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "n"))))


@pytest.mark.parametrize("kind, rows", [
    ("original", [(1, 275, 618, 446, 648, 3), (3, 285, 603, 435, 633, 9)]),
    ("original", [(1, 271, 607, 449, 648, 3), (3, 281, 592, 438, 633, 9)]),
    ("visual", [(2, 268, 580, 452, 610, 7), (4, 188, 580, 532, 610, 0)]),
    ("visual", [(2, 258, 600, 467, 630, 7), (4, 178, 600, 547, 630, 0)]),
])
def test_equal_scores_leave_it_to_the_order(spark, kind, rows):
    """Scores that are equal as decimals: the first band counts, not the one that floats put a trace higher."""
    f = bands(spark, rows)
    frame = bands(spark, [(9, 100, 700, 600, 740, 9)]).select("video_id", "frame_id", "frame_width", "frame_height", F.col("b").alias("e"), F.lit(None).cast(B.BOX).alias("detected"))
    got = B.primary(frame, f if kind == "original" else f.limit(0), f if kind == "visual" else f.limit(0)).first()
    assert (got.primary.x1, got.confidence) == (rows[0][1], kind)


def test_middles_round_as_sql_rounds(spark):
    """A middle of 131.0405 seconds is a trace over the half as a thousandfold, one of 129.9895 under it."""
    cues = spark.createDataFrame([("v", 1, 131000, 131081), ("v", 2, 129900, 130079)], "video_id string, ord long, start_ms long, end_ms long").withColumn("t", F.lit(300.0))
    for fill in (False, True):
        got = S.near_centre(cues, "t", 2, 500.0 if fill else 1.0, fill=fill, keys=("video_id", "t")).first().seconds
        assert got == [129.989, 131.041]


def test_data_url_is_one_line(spark):
    content = "x" * 200
    got = spark.range(1).select(T.data_url(F.lit("image/jpeg"), F.lit(content).cast("binary")).alias("u")).first().u
    assert got.split(",")[0] == "data:image/jpeg;base64" and not set(got) & set("\r\n") and len(got.split(",")[1]) == 4 * math.ceil(200 / 3)


@pytest.mark.parametrize("stem, first, every", [("ab12Der#.\nmehr#tag", "mehr#tag", "mehr"), ("ab12Der!#a\rb#tag", "家庭冲突爆发", "家庭冲突爆发"), ("ab12、x", "、x", "、x")])
def test_tags_of_titles(spark, stem, first, every):
    """A tag goes to the end of its line, which a line feed alone ends; of several lines the first one's alone, or all."""
    s = spark.createDataFrame([(stem,)], "s string")
    for kind, want in ((False, first), (True, every)):
        assert s.select(T.local_titles(F.col("s"), F.lit(""), kind)[0]["zh"].alias("t")).first().t == want
