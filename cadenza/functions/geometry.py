"""Boxes and layout. A box is a struct with x1, y1, x2, y2 and, where it has them, width, height and component_count."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Code defaults of the placement and quality rules; ratios are of the frame's width or height."""

    gap_px: int = 22
    gap_ratio: float = 0.016
    max_gap_ratio: float = 0.024
    max_margin_ratio: float = 0.48
    min_source_width: float = 0.18
    max_source_height: float = 0.11
    center_tolerance: float = 0.25
    preferred_y: float = 0.64
    pair_center_tolerance: float = 0.24
    pair_min_y2: float = 0.35
    pair_max_y2: float = 0.76
    pair_y2_tolerance: float = 0.09
    pair_ideal_gap: float = 0.026
    pair_max_gap: int = 160
    visual_center_tolerance: float = 0.28
    visual_max_gap: int = 140
    visual_overlap: float = 0.18
    visual_vertical_overlap: float = 0.35
    detected_max_gap: int = 220
    detected_overlap: float = 0.18
    above_px: int = 12
    pair_overlap: float = 0.25
    bottom_pad: int = 6
    thin_height: int = 28
    thin_pad: int = 4
    bottom_tolerance: float = 0.02
    edge: int = 8
    max_english_height: float = 0.085
    min_gap_px: int = 10
    min_gap_ratio: float = 0.008
    max_gap_px: int = 58
    max_gap_of_height: float = 0.045
    max_outline_overlap: int = 30
    band_center_tolerance: float = 0.18
    min_vertical_overlap: int = 5


def whole(x: Column) -> Column:
    """Without its fraction, toward zero."""
    return x.cast("long")


def exact(x: float) -> Column:
    """A constant as the decimal it is written as, so that scores made of such ones tie where they are equal."""
    return F.lit(Decimal(str(x)))


def width_of(b: Column) -> Column:
    return b["x2"] - b["x1"]


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Common width over the smaller one, which counts as 1 at least."""
    both = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    return both / F.greatest(F.lit(1), F.least(width_of(a), width_of(b)))


def vertical_overlap(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return both / F.greatest(F.lit(1), F.least(a["height"], b["height"]))


def similar_band(a: Column, b: Column, px: int = 6) -> Column:
    return (F.abs(a["y1"] - b["y1"]) <= px) & (F.abs(a["y2"] - b["y2"]) <= px)


def same_band(a: Column, b: Column) -> Column:
    return similar_band(a, b, 10) & (horizontal_overlap(a, b) > 0.7)


def font_size(height: Column) -> Column:
    return F.when(height >= 1440, 46).when(height >= 1080, 38).when(height >= 720, 30).otherwise(24)


def relative_gap(height: Column, o: Layout) -> Column:
    wanted = F.greatest(F.lit(o.gap_px), whole(height * F.lit(o.gap_ratio)))
    return F.least(wanted, F.greatest(F.lit(14), whole(height * F.lit(o.max_gap_ratio))))


def relative_margin(height: Column, y2: Column, font: Column, o: Layout) -> Column:
    """Margin below which new text stands right under a band."""
    bottom = F.least(height - 12, y2 + relative_gap(height, o) + font)
    low = F.greatest(F.lit(24), whole(height * F.lit(0.025)))
    high = F.greatest(low, whole(height * F.lit(o.max_margin_ratio)))
    return F.greatest(low, F.least(high, height - bottom))


def vision_bounds(height: Column) -> dict[str, tuple[Column, Column]]:
    low_margin = F.greatest(F.lit(40), whole(height * F.lit(0.06)))
    low_font = F.greatest(F.lit(18), whole(height * F.lit(0.018)))
    return {
        "margin_v": (low_margin, F.greatest(low_margin, whole(height * F.lit(0.38)))),
        "font_size_en": (low_font, F.greatest(low_font, whole(height * F.lit(0.035)))),
        "outline_width": (F.lit(1), F.lit(5)),
        "shadow": (F.lit(0), F.lit(3)),
    }


def source_bottom(band: Column, height: Column, detected_y2: Column, o: Layout) -> Column:
    """Where the source text is seen to end; a detected bottom near by bounds it."""
    pad = F.when(band["height"] < o.thin_height, o.bottom_pad + o.thin_pad).otherwise(o.bottom_pad)
    low = band["y2"] + pad
    near = (F.coalesce(detected_y2, F.lit(0)) != 0) & (F.abs(detected_y2 - band["y2"]) <= whole(height * F.lit(o.bottom_tolerance)))
    return F.when(near, F.greatest(band["y2"], F.least(low, detected_y2 + pad))).otherwise(F.greatest(band["y2"], low))


def source_limit(height: Column, detected_y2: Column, o: Layout) -> Column:
    """The lowest a source band may end."""
    all_ = whole(height * F.lit(o.pair_max_y2))
    return F.when(F.coalesce(detected_y2, F.lit(0)) == 0, all_).otherwise(F.least(all_, detected_y2 + whole(height * F.lit(o.pair_y2_tolerance))))


def anchor_bottom(y2: Column, font: Column, pad: Column | None = None) -> Column:
    """A band's bottom with its pad, by default 15 % of the font, half to even, and 4 at least."""
    own = F.greatest(F.lit(4), F.bround(font * F.lit(0.15), 0).cast("long"))
    return y2 + F.greatest(F.lit(0), own if pad is None else F.coalesce(pad, own))


def anchor(y2: Column, gap: Column, font: Column, height: Column, pad: Column | None = None) -> Column:
    y = anchor_bottom(y2, font, pad) + gap + font
    return F.greatest(whole(height * F.lit(0.5)), F.least(whole(height * F.lit(0.82)), y))


def choose_band(band: Column, fallback: Column, height: Column) -> Column:
    """The band, or the fallback where the band is too low, or too high and thin."""
    slack = whole(height * F.lit(0.04))
    low = band["y2"] > fallback["y2"] + slack
    high = (fallback["y2"] - band["y2"] > slack) & (F.coalesce(band["height"], F.lit(0)) < 28)
    return F.when(fallback.isNull() | band.isNull(), F.coalesce(band, fallback)).when(low | high, fallback).otherwise(band)


def fit_delta(gap: Column, confidence: Column, needed: str = "original", target: int = 18, low: int = 12, high: int = 28, most: int = 60) -> Column:
    """Pixels to move; null where the gap is right or the source is too unsure."""
    ranks = {"none": 0, "detected": 1, "visual": 2, "original": 3}
    table = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))
    sure = F.coalesce(table[confidence], F.lit(0)) >= ranks.get(needed, 1)
    return F.when(sure & ~gap.between(low, high), F.greatest(F.lit(-most), F.least(F.lit(most), target - gap)))


def move_text(line: Column, delta: Column, low: Column, high: Column) -> Column:
    """A line with its first position moved down by delta, within bounds; other lines stay."""
    pos = r"\\pos\(([-0-9.]+),([-0-9.]+)\)"
    x = F.bround(F.regexp_extract(line, pos, 1).try_cast("double"), 0).cast("long")
    y = F.bround(F.regexp_extract(line, pos, 2).try_cast("double") + delta, 0).cast("long")
    moved = F.greatest(low, F.least(high, y))
    new = F.concat(F.regexp_extract(line, r"(?s)^(.*?)" + pos, 1), F.lit(r"\pos("), x.cast("string"), F.lit(","), moved.cast("string"), F.lit(")"), F.regexp_extract(line, r"(?s)^.*?" + pos + "(.*)$", 3))
    return F.when(F.coalesce(delta, F.lit(0)).eqNullSafe(F.lit(0)) | ~line.rlike(pos), line).otherwise(new)


def cover_box(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Scale that covers the target and the middle cut of it."""
    scale = F.greatest(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    w, h = F.ceil(width * scale), F.ceil(height * scale)
    return F.struct(w.alias("width"), h.alias("height"), F.floor((w - to_width) / 2).alias("left"), F.floor((h - to_height) / 2).alias("top"))


def mean_brightness(value: Column, default: float = 128.0) -> Column:
    """Mean of a group's brightness, the default where nothing could be read."""
    return F.coalesce(F.avg(value), F.lit(default))


def outline_width(brightness: Column, bright: float = 190.0) -> Column:
    """Outline of texts: one wider on a bright ground."""
    return F.when(brightness > bright, 3).otherwise(2)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length; null for empty ones."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), F.size(a))


def alike(a: Column, b: Column, limit: float = 8.0) -> Column:
    """Whether two pictures are the same but for noise."""
    return mean_difference(a, b) < limit
