"""Queries over bands, components and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.geometry import Layout
from ..operators import bands as B
from . import views as V
from .catalog import query
from .views import COMPONENTS, FOUND


def _flat(df, column: str = "b", *more: str):
    return df.select("video_id", "frame_id", *(F.col(f"{column}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")), *more)


_TEXT = """letters AS (SELECT * FROM components WHERE y1 >= 1280 * 0.25 AND y2 <= 1280 * 0.88 AND x1 >= 720 * 0.04 AND x2 <= 720 * 0.96
  AND area >= 8 AND area <= 720 * 1280 * 0.01 AND y2 - y1 >= 1280 * 0.006 AND y2 - y1 <= 1280 * 0.075 AND x2 - x1 >= 2 AND x2 - x1 <= 720 * 0.35)"""


@query("x3_text_components", f"WITH {COMPONENTS}, {_TEXT} SELECT frame_id, x1, y1, x2, y2 FROM letters")
def x3_text_components(spark, d):
    return B.text_components(V.components(spark, d), 0.25, 0.88).select("frame_id", "x1", "y1", "x2", "y2")


_ROWS = f"""{COMPONENTS}, {_TEXT},
rows AS (SELECT frame_id, y, count(*) AS n FROM (SELECT frame_id, unnest(range(y1, least(y2, 1280))) AS y FROM letters) GROUP BY ALL HAVING count(*) >= 3),
isles AS (SELECT frame_id, y, y - row_number() OVER (PARTITION BY frame_id ORDER BY y) AS isle FROM rows),
runs AS (SELECT frame_id, min(y) AS y1, max(y) AS y2 FROM isles GROUP BY frame_id, isle HAVING count(*) >= 15),
marked AS (SELECT *, CASE WHEN y1 - lag(y2) OVER (PARTITION BY frame_id ORDER BY y1) <= 12 THEN 0 ELSE 1 END AS new FROM runs),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY y1)::BIGINT AS band FROM marked),
merged AS (SELECT frame_id, band, min(y1) AS y1, max(y2) AS y2, max(y2) - min(y1) + 1 AS height FROM numbered GROUP BY ALL)"""


@query("w11_row_bands", f"WITH {_ROWS} SELECT * FROM merged")
def w11_row_bands(spark, d):
    return B.row_bands(B.text_components(V.components(spark, d), 0.25, 0.88)).select("frame_id", "band", "y1", "y2", "height")


@query("a8_bands", f"""
WITH {_ROWS} SELECT frame_id, band, y1, y2, height, min(x1) AS x1, max(x2) AS x2, count(*) AS component_count, max(x2) - min(x1) AS width
FROM (SELECT DISTINCT m.*, l.x1, l.x2, l.y1 AS ly1, l.y2 AS ly2 FROM merged m JOIN letters l ON l.frame_id = m.frame_id AND l.y1 <= m.y2 AND l.y2 > m.y1)
GROUP BY frame_id, band, y1, y2, height HAVING count(*) >= 4""")
def a8_bands(spark, d):
    return B.bands(B.text_components(V.components(spark, d), 0.25, 0.88)).select("frame_id", "band", "y1", "y2", "height", "x1", "x2", "component_count", "width")


@query("a7_union_box", f"""
WITH {COMPONENTS} SELECT frame_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(x2) - min(x1) AS width, max(y2) - min(y1) AS height
FROM components WHERE area >= 80 AND x2 - x1 >= 8 AND y2 - y1 >= 8 GROUP BY frame_id""")
def a7_union_box(spark, d):
    return B.union_box(V.components(spark, d)).drop("video_id")


@query("a4_median_box", f"""
WITH {FOUND}, m AS (SELECT video_id, count(*) AS n, list_sort(list(x1)) AS a, list_sort(list(y1)) AS b, list_sort(list(x2)) AS c, list_sort(list(y2)) AS e FROM found GROUP BY video_id),
k AS (SELECT video_id, a[n // 2 + 1] AS x1, b[n // 2 + 1] AS y1, c[n // 2 + 1] AS x2, e[n // 2 + 1] AS y2, n AS sample_count FROM m)
SELECT *, greatest(0, x2 - x1) AS width, greatest(0, y2 - y1) AS height FROM k""")
def a4_median_box(spark, d):
    return B.median_box(V.found(spark, d).select("video_id", "b.x1", "b.y1", "b.x2", "b.y2"))


_PICK = """(SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {score} DESC, ord) AS rn FROM {rows}) WHERE rn = 1"""


@query("l4_original_band", f"""
WITH {FOUND}, c AS (SELECT *, width * 2.2 + n * 18 - abs((x1 + x2) / 2.0 - 360) * 1.1 - abs((y1 + y2) / 2.0 - 1280 * 0.64) * 0.55 - greatest(0, y2 - 1280 * 0.8) * 1.4 AS s
  FROM found WHERE width >= 720 * 0.18 AND height <= 1280 * 0.11 AND abs((x1 + x2) / 2.0 - 360) <= 720 * 0.25)
SELECT frame_id, ord, x1, y1, x2, y2 FROM {_PICK.format(score='round(s::DOUBLE, 6)', rows='c')}""")
def l4_original_band(spark, d):
    o = Layout()
    f = V.found(spark, d)
    b, w, h = F.col("b"), F.col("frame_width"), F.col("frame_height")
    fit = (b["width"] >= w * o.min_source_width) & (b["height"] <= h * o.max_source_height) & (F.abs((b["x1"] + b["x2"]) / 2 - w / 2) <= w * o.center_tolerance)
    return B.best(f.where(fit), F.round(B.source_score(b, w, h, o), 6), B.FRAME).select("frame_id", "ord", "b.x1", "b.y1", "b.x2", "b.y2")


_ENGLISH = f"""english AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y2 DESC, n DESC, ord) AS rn FROM found) WHERE rn = 1)"""


@query("l7_english_band", f"WITH {FOUND}, {_ENGLISH} SELECT frame_id, ord, x1, y1, x2, y2 FROM english")
def l7_english_band(spark, d):
    return B.english_band(V.found(spark, d)).select("frame_id", "ord", "b.x1", "b.y1", "b.x2", "b.y2")


def _frames(spark, d):
    """Each frame with its lowest band as the new text, odd lines as original bands, even ones as final; some frames know a detected box."""
    f = V.found(spark, d)
    e = B.english_band(f).select("video_id", "frame_id", "frame_width", "frame_height", F.col("b").alias("e"))
    y2 = F.col("e.y2")
    seen = F.when(F.col("frame_id") % 3 == 0, B.box(F.lit(100), y2 - 140 - F.col("frame_id") % 50, F.lit(600), y2 - 100 - F.col("frame_id") % 50, F.lit(0)))
    visible = F.when(F.col("frame_id") % 5 == 0, False).when(F.col("frame_id") % 5 == 1, True)
    return e.withColumn("detected", seen).withColumn("visible", visible), f.where("ord % 2 = 1"), f.where("ord % 2 = 0")


_OVERLAP = "(greatest(0, least(e.x2, b.x2) - greatest(e.x1, b.x1)) / greatest(1, least(e.width, b.width)))"
_FRAMES = f"""{FOUND}, {_ENGLISH},
frames AS (SELECT *, CASE WHEN frame_id % 3 = 0 THEN 100 END AS dx1, CASE WHEN frame_id % 3 = 0 THEN 600 END AS dx2, CASE WHEN frame_id % 3 = 0 THEN y2 - 140 - frame_id % 50 END AS dy1,
  CASE WHEN frame_id % 3 = 0 THEN y2 - 100 - frame_id % 50 END AS dy2, CASE WHEN frame_id % 5 = 0 THEN FALSE WHEN frame_id % 5 = 1 THEN TRUE END AS visible FROM english),
limits AS (SELECT *, CASE WHEN dy2 IS NULL THEN 972 ELSE least(972, dy2 + 115) END AS low FROM frames),
po AS (SELECT e.frame_id, b.*, b.width * 0.25 + b.n * 16 + b.y2 * 0.8 - abs((b.y1 + b.y2) / 2.0 - 1280 * 0.64) * 0.25 - abs(e.y1 - b.y2 - 1280 * 0.026) * 5.0 AS s
  FROM limits e JOIN found b ON b.frame_id = e.frame_id AND b.ord % 2 = 1
  WHERE b.width >= 720 * 0.18 AND b.y2 >= 1280 * 0.35 AND b.y2 <= e.low AND abs((b.x1 + b.x2) / 2.0 - 360) <= 720 * 0.24 AND b.y1 < e.y2 AND b.y1 <= e.y1 - 12 AND {_OVERLAP} >= 0.25 AND e.y1 - b.y2 <= 160),
pf AS (SELECT e.frame_id, b.*, -abs(e.y1 - b.y2 - 1280 * 0.026) * 4 + b.width * 0.35 + b.n * 8 AS s
  FROM limits e JOIN found b ON b.frame_id = e.frame_id AND b.ord % 2 = 0
  WHERE b.width >= 720 * 0.18 AND NOT (abs(b.y1 - e.y1) <= 10 AND abs(b.y2 - e.y2) <= 10 AND {_OVERLAP} > 0.7) AND b.y2 <= e.low AND b.y1 < e.y2 AND b.y1 <= e.y1 - 12
    AND greatest(0, least(e.y2, b.y2) - greatest(e.y1, b.y1)) / greatest(1, least(e.height, b.height)) <= 0.35
    AND abs((b.x1 + b.x2) / 2.0 - 360) <= 720 * 0.28 AND {_OVERLAP} >= 0.18 AND e.y1 - b.y2 <= 140),
o1 AS (SELECT * FROM (SELECT * EXCLUDE (frame_id_1), row_number() OVER (PARTITION BY frame_id ORDER BY s::DOUBLE DESC, ord) AS rk FROM po) WHERE rk = 1),
f1 AS (SELECT * FROM (SELECT * EXCLUDE (frame_id_1), row_number() OVER (PARTITION BY frame_id ORDER BY s::DOUBLE DESC, ord) AS rk FROM pf) WHERE rk = 1),
d1 AS (SELECT e.* FROM frames e, LATERAL (SELECT e.dx1 AS x1, e.dx2 AS x2, e.dx2 - e.dx1 AS width) b
  WHERE e.dx1 IS NOT NULL AND e.dx2 - e.dx1 >= 720 * 0.18 AND e.dy1 < e.y2 AND e.dy1 <= e.y1 - 12 AND {_OVERLAP} >= 0.18 AND e.y1 - e.dy2 <= 220),
prim AS (SELECT e.*, CASE WHEN o1.frame_id IS NOT NULL THEN o1.x1 WHEN f1.frame_id IS NOT NULL THEN f1.x1 ELSE d1.dx1 END AS px1,
  CASE WHEN o1.frame_id IS NOT NULL THEN o1.x2 WHEN f1.frame_id IS NOT NULL THEN f1.x2 ELSE d1.dx2 END AS px2,
  CASE WHEN o1.frame_id IS NOT NULL THEN o1.y1 WHEN f1.frame_id IS NOT NULL THEN f1.y1 ELSE d1.dy1 END AS py1,
  CASE WHEN o1.frame_id IS NOT NULL THEN o1.y2 WHEN f1.frame_id IS NOT NULL THEN f1.y2 ELSE d1.dy2 END AS py2
  FROM frames e LEFT JOIN o1 ON o1.frame_id = e.frame_id LEFT JOIN f1 ON f1.frame_id = e.frame_id LEFT JOIN d1 ON d1.frame_id = e.frame_id)"""
_FRAMES = _FRAMES.replace("SELECT e.frame_id, b.*,", "SELECT e.frame_id, b.ord, b.x1, b.y1, b.x2, b.y2, b.width, b.height, b.n,").replace("* EXCLUDE (frame_id_1)", "*")


@query("l5_primary_band", f"""
WITH {_FRAMES} SELECT frame_id, px1, py1, px2, py2, CASE WHEN py1 IS NULL THEN 'none'
  WHEN EXISTS (SELECT 1 FROM found b WHERE b.frame_id = prim.frame_id AND b.ord % 2 = 1 AND abs(b.y1 - py1) <= 6 AND abs(b.y2 - py2) <= 6) THEN 'original'
  WHEN EXISTS (SELECT 1 FROM found b WHERE b.frame_id = prim.frame_id AND b.ord % 2 = 0 AND abs(b.y1 - py1) <= 6 AND abs(b.y2 - py2) <= 6) THEN 'visual' ELSE 'detected' END AS confidence FROM prim""")
def l5_primary_band(spark, d):
    out = B.primary(*_frames(spark, d))
    return out.select("frame_id", *(F.col(f"primary.{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")), "confidence")


_BOTTOM = "greatest(py2, CASE WHEN coalesce(dy2, 0) <> 0 AND abs(dy2 - py2) <= 25 THEN least(py2 + pad, dy2 + pad) ELSE py2 + pad END)"
_QC = f"""{_FRAMES},
gaps AS (SELECT *, y1 - {_BOTTOM} AS gap FROM (SELECT *, CASE WHEN py2 - py1 < 28 THEN 10 ELSE 6 END AS pad FROM prim)),
met AS (SELECT e.frame_id, b.ord, NOT (e.y2 < b.y1 OR e.y1 > b.y2) AS over, greatest(0, least(e.y2, b.y2) - greatest(e.y1, b.y1)) AS depth, least(abs(e.y1 - b.y2), abs(b.y1 - e.y2)) AS near,
    abs((b.x1 + b.x2) / 2.0 - 360) <= 720 * 0.18 AS central,
    coalesce(abs(b.y1 - e.py1) <= 10 AND abs(b.y2 - e.py2) <= 10 AND greatest(0, least(b.x2, e.px2) - greatest(b.x1, e.px1)) / greatest(1, least(b.width, e.px2 - e.px1)) > 0.7, FALSE) AS own, b.y1 >= e.y1 AS under, b.y1 >= e.y2 AS wholly
  FROM prim e JOIN found b ON b.frame_id = e.frame_id AND b.ord % 2 = 1 WHERE {_OVERLAP} >= 0.25),
told AS (SELECT frame_id, ord, over AND central AND own AS mine, depth, near FROM met WHERE NOT (over AND under AND depth < 5) AND NOT (NOT over AND wholly) AND ((over AND central AND own) OR over OR near < 10)),
bandbad AS (SELECT frame_id, list('English subtitle too close to original subtitle/text band: gap=' || near || 'px' ORDER BY ord) AS m FROM told WHERE mine AND depth > 30 GROUP BY frame_id),
bandodd AS (SELECT frame_id, list(CASE WHEN mine THEN 'English subtitle too close to original subtitle/text band: gap=' ELSE 'English subtitle near non-primary text band: gap=' END || near || 'px' ORDER BY ord) AS m FROM told WHERE NOT (mine AND depth > 30) GROUP BY frame_id),
qc AS (SELECT g.video_id, g.frame_id,
    list_filter([CASE WHEN height > 108 THEN 'English subtitle bbox too tall: ' || height || 'px' END,
      CASE WHEN x1 <= 8 OR x2 >= 712 OR y1 <= 8 OR y2 >= 1272 THEN 'English subtitle bbox is clipped by frame edge' END,
      CASE WHEN gap < -30 THEN 'English subtitle overlaps original Chinese subtitle: overlap=' || abs(gap) || 'px' END], lambda x: x IS NOT NULL) || coalesce(bb.m, []) AS issues,
    list_filter([CASE WHEN gap >= -30 AND gap < 10 THEN 'English subtitle too close to original Chinese subtitle: gap=' || gap || 'px' END,
      CASE WHEN gap >= 10 AND gap > 57 THEN 'English subtitle too far from original Chinese subtitle: gap=' || gap || 'px' END,
      CASE WHEN NOT visible THEN 'English subtitle appears where the original frame has no subtitle evidence' END], lambda x: x IS NOT NULL) || coalesce(bo.m, []) AS warnings
  FROM gaps g LEFT JOIN bandbad bb ON bb.frame_id = g.frame_id LEFT JOIN bandodd bo ON bo.frame_id = g.frame_id)"""


def _reports(spark, d):
    frames, originals, finals = _frames(spark, d)
    return B.judged(B.chosen(B.gathered(frames, _originals=originals, _finals=finals)))


@query("f31_frame_issues", f"WITH {_QC} SELECT frame_id, array_to_string(issues, '|') AS issues, array_to_string(warnings, '|') AS warnings, len(issues) = 0 AS passed FROM qc")
def f31_frame_issues(spark, d):
    return _reports(spark, d).select("frame_id", F.array_join("issues", "|").alias("issues"), F.array_join("warnings", "|").alias("warnings"), "passed")


@query("a10_video_verdict", f"""
WITH {_QC} SELECT video_id, count(*) AS checked_frames, bool_and(len(issues) = 0) AS passed, array_to_string(flatten(list(issues ORDER BY frame_id)), '|') AS issues,
  array_to_string(flatten(list(warnings ORDER BY frame_id)), '|') AS warnings FROM qc GROUP BY video_id""")
def a10_video_verdict(spark, d):
    return B.verdict(_reports(spark, d)).select("video_id", "checked_frames", "passed", F.array_join("issues", "|").alias("issues"), F.array_join("warnings", "|").alias("warnings"))


@query("f24_source_bottom", f"WITH {_FRAMES} SELECT frame_id, {_BOTTOM} AS bottom, y1 - {_BOTTOM} AS gap FROM (SELECT *, CASE WHEN py2 - py1 < 28 THEN 10 ELSE 6 END AS pad FROM prim) WHERE py1 IS NOT NULL")
def f24_source_bottom(spark, d):
    f = B.primary(*_frames(spark, d)).where("primary IS NOT NULL")
    bottom = G.source_bottom(F.col("primary"), F.col("frame_height"), F.col("detected.y2"), Layout())
    return f.select("frame_id", bottom.cast("long").alias("bottom"), (F.col("e.y1") - bottom).cast("long").alias("gap"))


@query("f28_fit_deltas", f"""
WITH {_FRAMES}, g AS (SELECT frame_id, y1 - {_BOTTOM} AS gap, ['none', 'detected', 'visual', 'original'][frame_id % 4 + 1] AS confidence FROM (SELECT *, CASE WHEN py2 - py1 < 28 THEN 10 ELSE 6 END AS pad FROM prim) WHERE py1 IS NOT NULL)
SELECT frame_id, gap, CASE WHEN confidence IN ('visual', 'original') AND NOT gap BETWEEN 12 AND 28 THEN greatest(-60, least(60, 18 - gap)) END AS delta FROM g""")
def f28_fit_deltas(spark, d):
    f = f24_source_bottom(spark, d)
    confidence = F.element_at(F.array(*map(F.lit, ("none", "detected", "visual", "original"))), (F.col("frame_id") % 4 + 1).cast("int"))
    return f.select("frame_id", "gap", G.fit_delta(F.col("gap"), confidence, "visual").alias("delta"))


@query("f23_overlap_ratios", f"""
WITH {FOUND} SELECT a.frame_id, a.ord, b.ord AS other, round((greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(1, least(a.width, b.width)))::DOUBLE, 6) AS across,
  round((greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(1, least(a.height, b.height)))::DOUBLE, 6) AS down,
  abs(a.y1 - b.y1) <= 6 AND abs(a.y2 - b.y2) <= 6 AS alike FROM found a JOIN found b ON a.frame_id = b.frame_id AND b.ord = a.ord + 1""")
def f23_overlap_ratios(spark, d):
    f = V.found(spark, d)
    both = f.select("frame_id", "ord", "b").join(f.select("frame_id", (F.col("ord") - 1).alias("ord"), F.col("b").alias("c")), ["frame_id", "ord"])
    b, c = F.col("b"), F.col("c")
    return both.select("frame_id", "ord", (F.col("ord") + 1).alias("other"), F.round(G.horizontal_overlap(b, c), 6).alias("across"), F.round(G.vertical_overlap(b, c), 6).alias("down"), G.similar_band(b, c).alias("alike"))


@query("f21_relative_placement", """
SELECT p_partkey AS id, h AS height, CASE WHEN h >= 1440 THEN 46 WHEN h >= 1080 THEN 38 WHEN h >= 720 THEN 30 ELSE 24 END AS font,
  least(greatest(22, trunc(h * 0.016::DOUBLE)::BIGINT), greatest(14, trunc(h * 0.024::DOUBLE)::BIGINT)) AS gap,
  greatest(greatest(24, trunc(h * 0.025::DOUBLE)::BIGINT), least(greatest(greatest(24, trunc(h * 0.025::DOUBLE)::BIGINT), trunc(h * 0.48::DOUBLE)::BIGINT), h - least(h - 12, y2 + least(greatest(22, trunc(h * 0.016::DOUBLE)::BIGINT), greatest(14, trunc(h * 0.024::DOUBLE)::BIGINT)) + 30))) AS margin,
  greatest(trunc(h * 0.5::DOUBLE)::BIGINT, least(trunc(h * 0.82::DOUBLE)::BIGINT, y2 + greatest(4, round_even(font0 * 0.15::DOUBLE, 0)::BIGINT) + 30 + font0)) AS anchor
FROM (SELECT p_partkey, 400 + p_partkey % 1500 AS h, (400 + p_partkey % 1500) * (p_partkey % 9 + 1) // 10 AS y2, 20 + p_partkey % 41 AS font0 FROM part)""")
def f21_relative_placement(spark, d):
    i = F.col("p_partkey")
    h = 400 + i % 1500
    y2 = F.floor(h * (i % 9 + 1) / 10)
    p = V.table(spark, d, "part").select(i.alias("id"), h.alias("height"), y2.alias("y2"), (20 + i % 41).alias("font0"))
    h = F.col("height")
    return p.select("id", "height", G.font_size(h).alias("font"), G.relative_gap(h, Layout()).cast("long").alias("gap"), G.relative_margin(h, F.col("y2"), F.lit(30), Layout()).cast("long").alias("margin"), G.anchor(F.col("y2"), F.lit(30), F.col("font0"), h).cast("long").alias("anchor"))


@query("f22_vision_bounds", """
SELECT p_partkey AS id, greatest(greatest(40, trunc(h * 0.06::DOUBLE)::BIGINT), least(greatest(greatest(40, trunc(h * 0.06::DOUBLE)::BIGINT), trunc(h * 0.38::DOUBLE)::BIGINT), coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_size * 20 END, greatest(40, trunc(h * 0.06::DOUBLE)::BIGINT)))) AS margin_v,
  greatest(1, least(5, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN trunc(p_size / 6.0)::BIGINT END, 1))) AS outline_width
FROM (SELECT *, 400 + p_partkey % 1500 AS h FROM part)""")
def f22_vision_bounds(spark, d):
    from ..functions.text import clamp_int

    i, h = F.col("p_partkey"), 400 + F.col("p_partkey") % 1500
    text = F.when(i % 7 == 0, "wide").otherwise((F.col("p_size") * 20).cast("string"))
    number = F.when(i % 5 != 0, F.col("p_size") / F.lit(6.0))
    low, high = G.vision_bounds(h)["margin_v"]
    a, b = G.vision_bounds(h)["outline_width"]
    return V.table(spark, d, "part").select(i.alias("id"), clamp_int(text, low, high).cast("long").alias("margin_v"), clamp_int(number, a, b, numeric=True).cast("long").alias("outline_width"))


@query("f27_choose_band", f"""
WITH {FOUND} SELECT frame_id, ord, CASE WHEN fy2 IS NULL THEN y2 WHEN y2 > fy2 + 51 OR (fy2 - y2 > 51 AND height < 28) THEN fy2 ELSE y2 END AS chosen_y2
FROM (SELECT *, CASE WHEN ord % 4 <> 0 THEN 700 END AS fy2 FROM found)""")
def f27_choose_band(spark, d):
    f = V.found(spark, d)
    fallback = F.when(F.col("ord") % 4 != 0, B.box(F.lit(100), F.lit(650), F.lit(600), F.lit(700), F.lit(0)))
    return f.withColumn("fb", fallback).select("frame_id", "ord", G.choose_band(F.col("b"), F.col("fb"), F.col("frame_height"))["y2"].alias("chosen_y2"))


@query("f29_move_text", r"""
SELECT l_orderkey, l_linenumber, CASE WHEN d = 0 OR l_linenumber = 7 THEN line ELSE 'Dialogue: {\an2\pos(360,' || greatest(640, least(1100, y + d)) || ')}one \pos(1,2)' END AS moved
FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 'Dialogue: plain' ELSE 'Dialogue: {\an2\pos(360,' || y || ')}one \pos(1,2)' END AS line
  FROM (SELECT l_orderkey, l_linenumber, 600 + l_partkey % 600 AS y, l_suppkey % 5 * 10 - 20 AS d FROM lineitem))""")
def f29_move_text(spark, d):
    y, delta = 600 + F.col("l_partkey") % 600, F.col("l_suppkey") % 5 * 10 - 20
    line = F.when(F.col("l_linenumber") == 7, "Dialogue: plain").otherwise(F.concat(F.lit(r"Dialogue: {\an2\pos(360,"), y.cast("string"), F.lit(r")}one \pos(1,2)")))
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"), delta.alias("d"))
    return li.select("l_orderkey", "l_linenumber", G.move_text(F.col("line"), F.col("d"), F.lit(640), F.lit(1100)).alias("moved"))


@query("f41_cover_box", """
SELECT p_partkey AS id, ceil(w * s)::BIGINT AS width, ceil(h * s)::BIGINT AS height, (ceil(w * s)::BIGINT - 720) // 2 AS "left", (ceil(h * s)::BIGINT - 1280) // 2 AS top
FROM (SELECT *, greatest(720.0::DOUBLE / w, 1280.0::DOUBLE / h) AS s FROM (SELECT p_partkey, 300 + p_partkey % 900 AS w, 200 + p_size * 30 AS h FROM part))""")
def f41_cover_box(spark, d):
    w, h = 300 + F.col("p_partkey") % 900, 200 + F.col("p_size") * 30
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), G.cover_box(w, h, 720, 1280).alias("b")).select("id", "b.*")


@query("l9_best_frame", """
WITH s AS (SELECT vec_id, label, round(stddev_pop(v) * 100 + 0.12 * least(avg(v) * 100 + 100, 180), 6) AS score FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id, label)
SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn = 1""")
def l9_best_frame(spark, d):
    v = V.table(spark, d, "embeddings").select("vec_id", "label", F.explode("embedding").alias("e")).withColumn("v", F.col("e").cast("double"))
    s = v.groupBy("vec_id", "label").agg(F.round(B.frame_score(F.avg("v") * 100 + 100, F.stddev_pop("v") * 100), 6).alias("score"))
    return B.best(s.withColumn("frame_score", F.col("score")).drop("score"), F.col("frame_score"), ("label",), "vec_id").select("label", "vec_id", F.col("frame_score").alias("score"))


@query("x7_cover_similarity", """
SELECT a.vec_id, round(avg(abs(a.v - b.v)), 6) AS difference, avg(abs(a.v - b.v)) < 0.16 AS alike
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) a JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id""")
def x7_cover_similarity(spark, d):
    e = V.table(spark, d, "embeddings")
    both = e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    a, b = F.col("embedding"), F.col("other")
    return both.select("vec_id", F.round(G.mean_difference(a, b), 6).alias("difference"), G.alike(a, b, 0.16).alias("alike"))


@query("a5_brightness", """
SELECT label, coalesce(avg(v), 128) > 0 AS bright, CASE WHEN coalesce(avg(v), 128) > 0 THEN 3 ELSE 2 END AS outline FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label""")
def a5_brightness(spark, d):
    v = V.table(spark, d, "embeddings").select("label", F.explode("embedding").alias("e")).withColumn("v", F.col("e").cast("double"))
    mean = G.mean_brightness(F.col("v"))
    return v.groupBy("label").agg((mean > 0).alias("bright"), G.outline_width(mean, 0.0).alias("outline"))


@query("s9_frame_numbers", """SELECT l_orderkey, l_linenumber, greatest(0, least(999, floor(l_extendedprice / 1000 * 25)::BIGINT)) AS frame_no FROM lineitem""")
def s9_frame_numbers(spark, d):
    from ..functions.timecode import frame_number

    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", frame_number(F.col("l_extendedprice") / 1000, F.lit(25), F.lit(1000)).alias("frame_no"))


def _dealt(e):
    """Frames are much work for small rows, which a reader would leave in a few tasks: dealt over all cores before they are drawn."""
    return e.repartition(4 * e.sparkSession.sparkContext.defaultParallelism, "vec_id")


@query("x1_frame_pixels")
def x1_frame_pixels(spark, d):
    """Vectors drawn as frames of 64 by 96 with a light bar in the lower part of every other one."""
    from ..operators.pixels import analysed

    e = _dealt(V.table(spark, d, "embeddings").select("vec_id", "label"))
    ground, light = "202830", "F0F0F0"
    line = "".join(light if 8 <= x <= 55 and x % 4 < 2 else ground for x in range(64))
    pixels = F.unhex(F.when(F.col("vec_id") % 2 == 0, ground * 64 * 60 + line * 7 + ground * 64 * 29).otherwise(ground * 64 * 96))
    frames = e.select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"), F.lit(64).alias("frame_width"), F.lit(96).alias("frame_height"), pixels.alias("pixels"))
    return analysed(frames).select("video_id", "frame_id", F.round("brightness", 4).alias("brightness"), "visible", "visible_strict", F.size("components").alias("n_components"), F.size("boxes").alias("n_boxes"))


def frame_pairs(spark, d):
    """Finals and originals of 160 by 120: a letter of the original's line for each of ten components above 0, one of the line the final adds for each of ten others; every tenth final is cut short."""
    e = V.table(spark, d, "embeddings")
    ground, light = "202830", "F0F0F0"
    blank = F.lit(ground * 160)
    line = lambda first: F.concat(*(F.concat(F.when(F.get("embedding", F.lit(first + i)) > 0, light * 4).otherwise(ground * 4), F.lit(ground * 12)) for i in range(10)))
    rows = lambda row, n: F.repeat(row, F.lit(n))
    own = F.concat(rows(blank, 30), rows(line(0), 10))
    original = F.concat(own, rows(blank, 80))
    final = F.concat(own, rows(blank, 30), rows(line(20), 5), rows(blank, 45))
    frame = lambda pixels: e.select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"), F.lit(160).alias("frame_width"), F.lit(120).alias("frame_height"), F.unhex(pixels).alias("pixels"))
    return frame(F.when(F.col("vec_id") % 10 == 0, F.substring(final, 1, 6000)).otherwise(final)), frame(original)


@query("x2_added_text")
def x2_added_text(spark, d):
    """Text that only the final frame of a pair has, its components, and the bands they make."""
    from ..operators.pixels import added

    found = added(*frame_pairs(spark, d))
    keys = ("video_id", "frame_id")
    letters = found.select(*keys, "frame_width", "frame_height", F.explode("components").alias("c")).select(*keys, "frame_width", "frame_height", "c.*")
    bands = B.bands(B.text_components(letters, 0.25, 0.95), keys).groupBy(*keys).agg(F.count("*").alias("n_bands"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    told = found.select(*keys, "readable", "added_pixels", F.size("components").alias("n_components"))
    return told.join(bands, list(keys), "left").withColumn("n_bands", F.coalesce("n_bands", F.lit(0)))
