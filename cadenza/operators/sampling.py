"""Instants to look at."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

Keys = Sequence[str]


def thousandths(second: Column) -> Column:
    """Rounded to milliseconds: a thousandfold to the nearest integer, half to even, as SQL engines do, not the decimal that a float prints as."""
    return F.rint(second * 1000) / 1000


def even(duration: Column, n: int) -> Column:
    """n seconds that cut a duration evenly."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i * duration / F.lit(float(n + 1)))


def centred(duration: Column, n: int, interval: float = 1.0) -> Column:
    """n seconds around the middle, ``interval`` apart, within the duration."""
    first = duration / 2 - (n - 1) / 2 * interval
    return F.when(duration <= 0, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.lit(0.0), F.least(duration, first + i * F.lit(interval)))))


#: Shares looked at first around the middle, and of three even ones.
MIDDLE, THREE = (0.45, 0.5, 0.55), (0.1, 0.5, 0.9)


def shares(duration: Column, n: Column | int, strategy: str = "even") -> Column:
    """n seconds as shares of the duration: evenly, or around the middle and then evenly in between."""
    n = F.lit(n) if isinstance(n, int) else n
    cut = lambda k: F.transform(F.filter(F.sequence(F.lit(0), k), lambda i: i > 0), lambda i: i / (k + F.lit(1.0)))
    first = F.array(*map(F.lit, THREE if strategy == "even" else MIDDLE))
    if strategy == "even":
        ratio = F.when(n == 3, first).otherwise(cut(n))
    else:
        more = F.greatest(F.lit(0), n - 3)
        ratio = F.when(n <= 1, F.slice(first, 2, 1)).when(n <= 3, F.slice(first, 1, F.greatest(F.lit(1), n))).otherwise(F.sort_array(F.concat(first, F.array_except(cut(more), first))))
    return F.transform(ratio, lambda r: duration * r)


def scattered(duration: Column, n: int, seed: int) -> Column:
    """n seconds between 8 % and 92 % of the duration, in order, by a seeded hash of it: the same however rows are dealt."""
    chance = lambda k: F.pmod(F.xxhash64(duration, F.lit(seed), F.lit(k)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    return F.sort_array(F.array(*(duration * (F.lit(0.08) + chance(k) * 0.84) for k in range(n))))


def near_centre(cues: DataFrame, duration: str, n: int, interval: float = 1.0, clamp: bool = False, fill: bool = False, keys: Keys = ("video_id",)) -> DataFrame:
    """The n cue middles nearest to the middle of the video that keep ``interval`` seconds apart, in order.

    With ``clamp`` a middle stays 50 ms inside its cue, with ``fill`` missing
    ones are made up from the nearest regardless of the spacing. Each choice
    depends on the choices before, so there is a round for each: of the cues
    that come after the last choice and keep apart from all, the nearest, a
    minimum that Spark combines before the shuffle. A round carries a track's
    choices, n at most, to its cues; no task holds a track.
    """
    middle = (F.col("start_ms") + F.col("end_ms")) / F.lit(2.0)
    second = middle / 1000
    if clamp:
        second = F.greatest(F.col("start_ms") / F.lit(1000.0) + 0.05, F.least(F.col("end_ms") / F.lit(1000.0) - 0.05, second))
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.col(duration), x))
    plain = thousandths(inside(middle / 1000))
    tested = second if clamp else plain
    c = F.struct(F.abs(middle - F.col(duration) * 500).alias("d"), "ord", tested.alias("t"), thousandths(inside(second)).alias("s"), plain.alias("p"))
    rows = written(cues.where("end_ms > start_ms").select(*keys, c.alias("c")), "middles")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    tracks = [f"_k_{k}" for k in keys]
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    # A track's state: the seconds taken so far and the last cue chosen.
    got = rows.groupBy(*named).agg(F.min("c").alias("last")).select(*tracks, F.slice(F.array("last.s"), 1, min(n, 1)).alias("taken"), "last")
    for _ in range(n - 1):
        after = F.struct("c.d", "c.ord") > F.struct("last.d", "last.ord")
        apart = F.forall("taken", lambda g: F.abs(F.col("c.t") - g) >= interval)
        best = rows.join(got, same).groupBy(*tracks).agg(F.min(F.when(after & apart, F.col("c"))).alias("best"), F.first("taken").alias("taken"), F.first("last").alias("last"))
        took = F.when(F.col("best").isNull(), F.col("taken")).otherwise(F.array_append("taken", F.col("best.s")))
        got = best.select(*tracks, took.alias("taken"), F.coalesce("best", "last").alias("last"))
    if fill:
        # Of cues at one second the nearest counts, and a track needs n at most: ranks cut them before the shuffle.
        rest = rows.join(got, same).where((F.size("taken") < n) & ~F.array_contains("taken", F.col("c.p"))).groupBy(*tracks, "c.p").agg(F.min(F.struct("c.d", "c.ord")).alias("near"), F.first(F.size("taken")).alias("had"))
        rest = rest.withColumn("place", F.row_number().over(Window.partitionBy(*tracks).orderBy("near"))).where((F.col("place") <= n)).where(F.col("place") <= n - F.col("had"))
        more = rest.groupBy(*(F.col(k).alias(f"_m{k}") for k in tracks)).agg(F.collect_list("p").alias("more"))
        match = F.lit(True)
        for k in tracks:
            match = match & F.col(k).eqNullSafe(F.col(f"_m{k}"))
        got = got.join(more, match, "left").withColumn("taken", F.concat("taken", F.coalesce("more", F.array().cast("array<double>"))))
    return got.select(*(F.col(f"_k_{k}").alias(k) for k in keys), F.sort_array("taken").alias("seconds"))


def strided(cues: DataFrame, most: int, keys: Keys = ("video_id",)) -> DataFrame:
    """Every k-th cue, k = cues // most, and of those the first ``most``; all if there are no more or ``most`` is 0."""
    if most <= 0:
        return cues
    w = Window.partitionBy(*keys)
    tall = cues.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("ord")) - 1)
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return tall.where((F.col("_n") <= most) | ((F.col("_i") % stride == 0) & (F.col("_i") / stride < most))).drop("_n", "_i")


def first_seen(hits: DataFrame, until: float = 12.0, lead_ms: int = 200, keys: Keys = ("video_id",)) -> DataFrame:
    """When text is first visible by ``hits`` (keys, ``second``, ``visible``), a little before it; null if it is not."""
    at = F.min(F.when(F.col("visible") & (F.col("second") <= until), F.col("second")))
    return hits.groupBy(*keys).agg(F.greatest(F.lit(0), (at * 1000).cast("long") - lead_ms).alias("raw"), at.alias("at")).select(*keys, F.when(F.col("at").isNotNull(), F.col("raw")).alias("first_visual_ms"))


def first_seen_by(frames: DataFrame, detect: Callable[[dict], bool | None], until: float = 12.0, lead_ms: int = 200, keys: Keys = ("video_id",)) -> DataFrame:
    """``first_seen`` with the detector asked on the way: a video's frames (keys, ``second`` and more) pass in order, and after its first hit the rest pass unasked.

    ``detect`` gets a frame's row as a dict. A video without a frame up to
    ``until`` or without a hit gives null.
    """
    types = dict(frames.dtypes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, hit = None, True
        for batch in it:
            names = batch.schema.names
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            seconds, found = batch.column("second").to_pylist(), []
            for i, (at, second) in enumerate(zip(ids, seconds, strict=True)):
                if (at,) != here:
                    here, hit = (at,), False
                    found.append((i, None))
                # Only the frames that are asked become Python values.
                if not hit and second is not None and second <= until and detect({c: batch.column(c)[i].as_py() for c in names}):
                    hit = True
                    found.append((i, second))
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), pa.array([s for _, s in found], pa.float64())], names=[*keys, "at"])

    near = frames.withColumn("second", F.col("second").cast("double")).repartition(*keys).sortWithinPartitions(*keys, "second")
    hits = near.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", at double")
    at = F.max("at")
    return hits.groupBy(*keys).agg(F.when(at.isNotNull(), F.greatest(F.lit(0), (at * 1000).cast("long") - lead_ms)).alias("first_visual_ms"))


def seen_near(hits: DataFrame, instants: DataFrame, reach: float = 0.15, keys: Keys = ("video_id",)) -> DataFrame:
    """Whether text is visible at an instant (keys, ``second``) or ``reach`` around it: true, false, or null if nothing could be read."""
    wanted = instants.select(*keys, "second", F.explode(F.array(*(F.bround(F.col("second") + d, 3) for d in (-reach, 0.0, reach)))).alias("at"))
    known = hits.select(*keys, F.bround("second", 3).alias("at"), "visible")
    return wanted.join(known, [*keys, "at"], "left").groupBy(*keys, "second").agg(F.bool_or("visible").alias("visible"))
