"""Size of a title: the largest at which measured lines fit the safe area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extents(lines: DataFrame, gap: int = 11, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Widest line and whole height of each size (keys, ``size``, ``line_no``, ``width``, ``height``)."""
    return lines.groupBy(*keys, "size").agg(F.max("width").alias("widest"), (F.sum("height") + gap * (F.count("*") - 1)).alias("tall"))


def fitting_size(lines: DataFrame, safe_width: int, safe_height: int, low: int = 40, high: int = 60, step: int = 2, gap: int = 11, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """The largest size tried, from ``high`` down, whose lines fit; null if none does."""
    tried = (F.col("size") <= high) & (F.col("size") >= low) & ((high - F.col("size")) % step == 0)
    fits = (F.col("widest") <= safe_width) & (F.col("tall") <= safe_height)
    # Sizes that are not tried are left out before they are added up; a title that has no others still counts.
    title = lines.select(*keys, F.when(tried, F.col("size")).alias("size"), "width", "height")
    return extents(title, gap, keys).groupBy(*keys).agg(F.max(F.when(fits, F.col("size"))).alias("size"))
