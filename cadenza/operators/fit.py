"""Fitting text to a target gap, round by round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def deltas(measured: DataFrame, needed: str = "original", **limits: int) -> DataFrame:
    """Moves (keys, ``index``, ``delta``) of measurements (``gap``, ``confidence``) that are off."""
    return measured.withColumn("delta", G.fit_delta(F.col("gap"), F.col("confidence"), needed, **limits)).where("delta IS NOT NULL").select("video_id", "index", "delta")


def moved(events: DataFrame, moves: DataFrame, low_ratio: float = 0.5, high_ratio: float = 0.86) -> DataFrame:
    """Events (``video_id``, ``ord``, ``line``, ``frame_height``) with their position moved by ``moves``, matched by number."""
    h = F.col("frame_height")
    both = events.join(moves.select("video_id", F.col("index").alias("ord"), "delta"), ["video_id", "ord"], "left")
    return both.withColumn("line", G.move_text(F.col("line"), F.col("delta"), G.whole(h * F.lit(low_ratio)), G.whole(h * F.lit(high_ratio)))).drop("delta")


def fit(events: DataFrame, measure: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame], rounds: int = 2, **options) -> tuple[DataFrame, list[dict]]:
    """Measures, moves and measures again until nothing is off or ``rounds`` are over; after a last move once more.

    ``cut`` stores a round's events and reads them back, so no round repeats
    the ones before. Returns the events and each round's counts.
    """
    told: list[dict] = []
    n = 0
    for k in range(1, rounds + 1):
        seen = measure(events)
        moves = cut(deltas(seen, **options))
        n = moves.count()
        told.append({"iteration": k, "measurement_count": seen.count(), "adjustment_count": n})
        if not n:
            break
        events = cut(moved(events, moves))
    if n:
        seen = measure(events)
        told.append({"iteration": "final_check", "measurement_count": seen.count(), "adjustment_count": deltas(seen, **options).count()})
    return events, told
