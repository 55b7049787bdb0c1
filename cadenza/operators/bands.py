"""Text bands of frames: from components to bands, and the choice among them.

Everything is keyed by frame; a frame's components and bands meet through
equal keys only, never across frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.geometry import Layout

Keys = Sequence[str]
FRAME = ("video_id", "frame_id")
BOX = "struct<x1: bigint, y1: bigint, x2: bigint, y2: bigint, width: bigint, height: bigint, component_count: bigint>"


def box(*columns: Column) -> Column:
    """A box of x1, y1, x2, y2 and a component count."""
    x1, y1, x2, y2, n = columns
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.greatest(F.lit(0), x2 - x1).alias("width"), (y2 - y1).alias("height"), n.alias("component_count")).cast(BOX)


def text_components(components: DataFrame, min_y: float, max_y: float) -> DataFrame:
    """Components (frame, ``frame_width``, ``frame_height``, x1..y2, ``area``) of a letter's size and place."""
    w, h = F.col("frame_width"), F.col("frame_height")
    own_w, own_h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return components.where(
        (F.col("y1") >= h * min_y)
        & (F.col("y2") <= h * max_y)
        & (F.col("x1") >= w * 0.04)
        & (F.col("x2") <= w * 0.96)
        & F.col("area").between(F.lit(8), w * h * 0.01)
        & own_h.between(F.greatest(F.lit(6.0), h * 0.006), h * 0.075)
        & own_w.between(F.lit(2.0), w * 0.35)
    )


def row_bands(components: DataFrame, keys: Keys = FRAME, least: int = 3) -> DataFrame:
    """Runs of rows that ``least`` components cover, low runs left out, near ones merged: ``y1``, ``y2`` (inclusive), ``height``.

    Coverage is counted from where components begin and end, not row by row.
    """
    ends = components.select(*keys, "frame_height", F.explode(F.array(F.struct(F.col("y1").alias("y"), F.lit(1).alias("d")), F.struct(F.least("y2", "frame_height").alias("y"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, "frame_height", F.col("e.y").alias("y")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("y")
    deep = steps.withColumn("active", F.sum("d").over(w) >= least).withColumn("before", F.coalesce(F.lag("active").over(w), F.lit(False)))
    deep = deep.withColumn("active", F.sum("d").over(w) >= least)
    turns = deep.where("active <> before").withColumn("next_y", F.lead("y").over(w))
    runs = turns.where("active").select(*keys, "frame_height", F.col("y").alias("y1"), (F.coalesce("next_y", "frame_height") - 1).alias("y2"))
    tall = runs.where(F.col("y2") - F.col("y1") + 1 >= F.greatest(F.lit(8), G.whole(F.col("frame_height") * F.lit(0.012))))
    v = Window.partitionBy(*keys).orderBy("y1")
    apart = F.col("y1") - F.lag("y2").over(v) > F.greatest(F.lit(4), G.whole(F.col("frame_height") * F.lit(0.01)))
    numbered = tall.withColumn("band", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(v))
    out = numbered.groupBy(*keys, "band").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    return out.withColumn("height", F.col("y2") - F.col("y1") + 1)


def bands(components: DataFrame, keys: Keys = FRAME, least: int = 4) -> DataFrame:
    """Bands with the extent and number of their distinct components, ``least`` at least."""
    rows = row_bands(components, keys)
    c = components.select(*keys, *(F.col(k).alias(f"c_{k}") for k in ("x1", "y1", "x2", "y2")))
    met = rows.join(c, list(keys)).where((F.col("c_y1") <= F.col("y2")) & (F.col("c_y2") > F.col("y1"))).select(*keys, "band", "y1", "y2", "height", "c_x1", "c_y1", "c_x2", "c_y2").distinct()
    out = met.groupBy(*keys, "band", "y1", "y2", "height").agg(F.min("c_x1").alias("x1"), F.max("c_x2").alias("x2"), F.count("*").alias("component_count"))
    return out.where(F.col("component_count") >= least).withColumn("width", F.col("x2") - F.col("x1"))


def union_box(boxes: DataFrame, keys: Keys = FRAME, least: int = 80) -> DataFrame:
    """One box around all of some size."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    some = boxes.where((w * h >= least) & (h >= 8) & (w >= 8))
    out = some.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return out.withColumn("width", F.col("x2") - F.col("x1")).withColumn("height", F.col("y2") - F.col("y1"))


def median_box(boxes: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """Upper median of each coordinate on its own.

    Found by rank: no list of a group's values is gathered.
    """
    tall = boxes.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("long").alias("v")) for c in ("x1", "y1", "x2", "y2")))).alias("e")).select(*keys, "e.c", "e.v")
    counts = tall.groupBy(*keys, "c", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "c")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    hit = run.where((F.floor(F.col("all") / 2) < F.col("upto")) & (F.floor(F.col("all") / 2) >= F.col("upto") - F.col("n")))
    out = hit.groupBy(*keys).pivot("c", ["x1", "y1", "x2", "y2"]).agg(F.first("v")).join(boxes.groupBy(*keys).agg(F.count("*").alias("sample_count")), list(keys))
    return out.withColumn("width", F.greatest(F.lit(0), F.col("x2") - F.col("x1"))).withColumn("height", F.greatest(F.lit(0), F.col("y2") - F.col("y1")))


def best(candidates: DataFrame, score: Column, keys: Keys, order: Column | str = "ord") -> DataFrame:
    """The candidate with the highest score of each key; of equal ones the first."""
    rest = [c for c in candidates.columns if c not in keys]
    top = F.max(F.struct(score.cast("double").alias("score"), (-F.col(order) if isinstance(order, str) else -order).alias("first"), F.struct(*rest).alias("row"))).alias("top")
    return candidates.groupBy(*keys).agg(top).select(*keys, "top.row.*", "top.score")


def source_score(b: Column, width: Column, height: Column, o: Layout = Layout()) -> Column:
    """How much a band looks like the source's subtitles."""
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return b["width"] * 2.2 + F.coalesce(b["component_count"], F.lit(0)) * 18 - F.abs(cx - width / 2) * 1.1 - F.abs(cy - height * o.preferred_y) * 0.55 - F.greatest(F.lit(0.0), b["y2"] - height * 0.8) * 1.4


def original_band(found: DataFrame, keys: Keys = FRAME, o: Layout = Layout()) -> DataFrame:
    """The source band of each frame among ``found`` (``b`` box, ``frame_width``, ``frame_height``, ``ord``)."""
    b, w, h = F.col("b"), F.col("frame_width"), F.col("frame_height")
    fit = (b["width"] >= w * o.min_source_width) & (b["height"] <= h * o.max_source_height) & (F.abs((b["x1"] + b["x2"]) / 2 - w / 2) <= w * o.center_tolerance)
    return best(found.where(fit), source_score(b, w, h, o), keys)


def english_band(found: DataFrame, keys: Keys = FRAME) -> DataFrame:
    """The lowest band; of several the one with most components, then the first."""
    b = F.col("b")
    rest = [c for c in found.columns if c not in keys]
    top = F.max(F.struct(b["y2"].alias("y2"), F.coalesce(b["component_count"], F.lit(0)).alias("n"), (-F.col("ord")).alias("first"), F.struct(*rest).alias("row"))).alias("top")
    return found.groupBy(*keys).agg(top).select(*keys, "top.row.*")


def _above(b: Column, e: Column, o: Layout) -> Column:
    return (b["y1"] < e["y2"]) & (b["y1"] <= e["y1"] - o.above_px)


def primary_fit(b: Column, e: Column, w: Column, h: Column, detected_y2: Column, o: Layout = Layout()) -> tuple[Column, Column]:
    """Whether an original band can be the source of English box ``e``, and its score."""
    gap = e["y1"] - b["y2"]
    ok = (
        (b["width"] >= w * o.min_source_width)
        & (b["y2"] >= h * o.pair_min_y2)
        & (b["y2"] <= G.source_limit(h, detected_y2, o))
        & (F.abs((b["x1"] + b["x2"]) / 2 - w / 2) <= w * o.pair_center_tolerance)
        & _above(b, e, o)
        & (G.horizontal_overlap(e, b) >= o.pair_overlap)
        & (gap <= o.pair_max_gap)
    )
    # Decimals until the middle, a half, comes in: equal scores are equal, and then the first band counts.
    size = b["width"] * G.exact(0.25) + F.coalesce(b["component_count"], F.lit(0)) * 16 + b["y2"] * G.exact(0.8)
    middle = F.abs((b["y1"] + b["y2"]) / 2 - (h * G.exact(o.preferred_y)).cast("double"))
    return ok, size.cast("double") - middle * 0.25 - (F.abs(gap - h * G.exact(o.pair_ideal_gap)) * 5).cast("double")


def visual_fit(b: Column, e: Column, w: Column, h: Column, detected_y2: Column, o: Layout = Layout()) -> tuple[Column, Column]:
    """The same for a band of the final frame."""
    gap = e["y1"] - b["y2"]
    ok = (
        (b["width"] >= w * o.min_source_width)
        & ~G.same_band(b, e)
        & (b["y2"] <= G.source_limit(h, detected_y2, o))
        & _above(b, e, o)
        & (G.vertical_overlap(b, e) <= o.visual_vertical_overlap)
        & (F.abs((b["x1"] + b["x2"]) / 2 - w / 2) <= w * o.visual_center_tolerance)
        & (G.horizontal_overlap(e, b) >= o.visual_overlap)
        & (gap <= o.visual_max_gap)
    )
    return ok, -F.abs(gap - h * G.exact(o.pair_ideal_gap)) * 4 + b["width"] * G.exact(0.35) + F.coalesce(b["component_count"], F.lit(0)) * 8


def detected_fit(b: Column, e: Column, w: Column, o: Layout = Layout()) -> Column:
    return (b["width"] >= w * o.min_source_width) & _above(b, e, o) & (G.horizontal_overlap(e, b) >= o.detected_overlap) & (e["y1"] - b["y2"] <= o.detected_max_gap)


def gathered(frames: DataFrame, keys: Keys = FRAME, **found: DataFrame) -> DataFrame:
    """``frames`` with each table of bands (keys, ``b``, ``ord``) as an array in order, empty where a frame has none.

    A frame's rows bound its bands, so the arrays are short; all that follows
    is then one projection instead of a join per rule.
    """
    out = frames
    none = F.array().cast(f"array<struct<ord: bigint, b: {BOX}>>")
    for name, bands_ in found.items():
        rows = bands_.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("b").cast(BOX).alias("b")))).alias(name))
        out = out.join(rows, list(keys), "left").withColumn(name, F.coalesce(name, none))
    return out


def _top(bands_: Column, fit) -> Column:
    """The fitting band with the highest score, of equal ones the first; null without any."""
    fits = F.filter(bands_, lambda s: F.coalesce(fit(s["b"])[0], F.lit(False)))
    return F.array_max(F.transform(fits, lambda s: F.struct(fit(s["b"])[1].cast("double").alias("score"), (-s["ord"]).alias("first"), s["b"].alias("b"))))["b"]


def primary(frames: DataFrame, originals: DataFrame, finals: DataFrame, keys: Keys = FRAME, o: Layout = Layout()) -> DataFrame:
    """Adds ``primary``, the source box of each frame, and ``confidence``: an original band, else a final one, else the detected box.

    ``frames``: keys, ``frame_width``, ``frame_height``, ``e`` (English box), ``detected`` (box or null);
    ``originals`` and ``finals``: keys, ``b``, ``ord``.
    """
    return chosen(gathered(frames, keys, _originals=originals, _finals=finals), o).drop("_originals", "_finals")


def chosen(tall: DataFrame, o: Layout = Layout()) -> DataFrame:
    """The same for frames that hold their bands as ``_originals`` and ``_finals``."""
    w, h, e, y2 = F.col("frame_width"), F.col("frame_height"), F.col("e"), F.col("detected")["y2"]
    first = _top(F.col("_originals"), lambda b: primary_fit(b, e, w, h, y2, o))
    second = _top(F.col("_finals"), lambda b: visual_fit(b, e, w, h, y2, o))
    out = tall.withColumn("primary", F.coalesce(first, second, F.when(detected_fit(F.col("detected"), e, w, o), F.col("detected"))))
    like = lambda c: F.exists(F.col(c), lambda s: G.similar_band(F.col("primary"), s["b"]))
    return out.withColumn("confidence", F.when(F.col("primary").isNull(), "none").when(like("_originals"), "original").when(like("_finals"), "visual").otherwise("detected"))


def issues(frames: DataFrame, originals: DataFrame, keys: Keys = FRAME, o: Layout = Layout()) -> DataFrame:
    """Verdict of each frame: keys, ``passed``, ``issues`` and ``warnings`` in order.

    ``frames``: keys, ``frame_width``, ``frame_height``, ``e``, ``detected``, ``primary``, ``visible`` (null: unknown).
    """
    return judged(gathered(frames, keys, _originals=originals), keys, o)


def judged(tall: DataFrame, keys: Keys = FRAME, o: Layout = Layout()) -> DataFrame:
    """The same for frames that hold their original bands as ``_originals``."""
    w, h, e, p = (F.col(c) for c in ("frame_width", "frame_height", "e", "primary"))
    low = F.greatest(F.lit(o.min_gap_px), G.whole(h * F.lit(o.min_gap_ratio)))
    high = F.least(F.lit(o.max_gap_px), G.whole(h * F.lit(o.max_gap_of_height)))
    gap = e["y1"] - G.source_bottom(p, h, F.col("detected")["y2"], o)
    px = lambda x: F.concat(x.cast("string"), F.lit("px"))
    say = lambda ok, *parts: F.when(ok, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))
    there, paired = e.isNotNull(), e.isNotNull() & p.isNotNull()
    bad = [
        say(~there, "new English subtitle not detected"),
        say(there & (e["height"] > G.whole(h * F.lit(o.max_english_height))), "English subtitle bbox too tall: ", px(e["height"])),
        say(there & ((e["x1"] <= o.edge) | (e["x2"] >= w - o.edge) | (e["y1"] <= o.edge) | (e["y2"] >= h - o.edge)), "English subtitle bbox is clipped by frame edge"),
        say(paired & (gap < -o.max_outline_overlap), "English subtitle overlaps original Chinese subtitle: overlap=", px(F.abs(gap))),
    ]
    odd = [
        say(paired & (gap >= -o.max_outline_overlap) & (gap < low), "English subtitle too close to original Chinese subtitle: gap=", px(gap)),
        say(paired & (gap >= low) & (gap > high), "English subtitle too far from original Chinese subtitle: gap=", px(gap)),
        say(there & ~F.col("visible"), "English subtitle appears where the original frame has no subtitle evidence"),
    ]

    def told(s: Column) -> Column:
        """1: a warning, 2: an issue, null: nothing; with its message."""
        b = s["b"]
        over = ~((e["y2"] < b["y1"]) | (e["y1"] > b["y2"]))
        depth = F.greatest(F.lit(0), F.least(e["y2"], b["y2"]) - F.greatest(e["y1"], b["y1"]))
        spared = (G.horizontal_overlap(e, b) < o.pair_overlap) | (over & (b["y1"] >= e["y1"]) & (depth < o.min_vertical_overlap)) | (~over & (b["y1"] >= e["y2"]))
        near = F.least(F.abs(e["y1"] - b["y2"]), F.abs(b["y1"] - e["y2"]))
        central = F.abs((b["x1"] + b["x2"]) / 2 - w / 2) <= w * o.band_center_tolerance
        own = over & central & F.coalesce(G.same_band(b, p), F.lit(False))
        kind = F.when(own, F.when(depth <= o.max_outline_overlap, 1).otherwise(2)).when(over | (near < low), 1)
        text = F.when(own, "English subtitle too close to original subtitle/text band: gap=").otherwise("English subtitle near non-primary text band: gap=")
        return F.struct(F.when(there & ~spared, kind).alias("kind"), F.concat(text, px(near)).alias("message"))

    found = tall.select(*keys, F.array_compact(F.array(*bad)).alias("bad"), F.array_compact(F.array(*odd)).alias("odd"), F.transform("_originals", told).alias("told"))
    listed = lambda kind: F.transform(F.filter("told", lambda t: t["kind"] == kind), lambda t: t["message"])
    out = found.select(*keys, F.concat("bad", listed(2)).alias("issues"), F.concat("odd", listed(1)).alias("warnings"))
    return out.withColumn("passed", F.size("issues") == 0)


def verdict(reports: DataFrame, keys: Keys = ("video_id",), order: str = "frame_id") -> DataFrame:
    """All frames' issues and warnings in frame order; passed without issues. A video has a few sampled frames."""
    flat = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda s: s[c]))
    return reports.groupBy(*keys).agg(F.count("*").alias("checked_frames"), F.bool_and("passed").alias("passed"), flat("issues").alias("issues"), flat("warnings").alias("warnings"))


def final_verdict(rules: Column, ai: Column, ai_may_fail: bool = False) -> tuple[Column, Column]:
    """Passed, and whether it passed against the model's word. A null ``ai`` was not asked."""
    spared = rules & ~F.coalesce(ai, F.lit(True)) & F.lit(not ai_may_fail)
    return F.when(spared, F.lit(True)).otherwise(rules & F.coalesce(ai, F.lit(True))), spared


def frame_score(mean: Column, deviation: Column) -> Column:
    return deviation + F.least(mean, F.lit(180.0)) * 0.12
