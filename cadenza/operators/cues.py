"""Cues: intervals with text, in the order ``ord`` within their keys.

A cue table has the key columns (by default ``video_id``), ``ord`` (the place
in the track), ``index``, ``start_ms``, ``end_ms`` and ``text``. All windows of
one operator share one partitioning, so Spark shuffles a track once; what
numbers, cleans and checks tracks goes by parts of them (``scan``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import written
from . import scan

Keys = Sequence[str]


@dataclass(frozen=True)
class Clean:
    min_ms: int = 800
    max_ms: int = 7000
    guard_from_ms: int = 500
    guard_shift_ms: int = 800
    merge_short: bool = True
    repeat_count: int = 4
    repeat_span_ms: int = 4000


@dataclass(frozen=True)
class Limits:
    gap_ms: int = 9000
    short_ms: int = 250
    long_ms: int = 9000
    gaps: int = 50
    items: int = 20


def track(keys: Keys):
    return Window.partitionBy(*keys).orderBy("ord")


def duration() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def solid(cues: DataFrame) -> DataFrame:
    """Cues whose text is not blank."""
    return cues.where(~T.is_blank(F.col("text")))


def positive(cues: DataFrame) -> DataFrame:
    return cues.where("end_ms > start_ms")


def renumber(cues: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """Index and order from 1 without holes."""
    return scan.numbered(cues, keys, "_n").withColumn("ord", F.col("_n")).withColumn("index", F.col("_n")).drop("_n")


def clamped(cues: DataFrame, o: Clean = Clean(), keys: Keys = ("video_id",), visual_start: str | None = None) -> DataFrame:
    """Starts from 0, durations within bounds. ``visual_start`` names a column with the time text is first seen: a first cue that starts too early moves there."""
    start = F.greatest(F.lit(0), F.col("start_ms"))
    out = cues.withColumn("start_ms", start).withColumn("end_ms", F.greatest(F.col("start_ms") + o.min_ms, F.col("end_ms")))
    if visual_start:
        seen = F.col(visual_start)
        early = (F.col("_n") == 1) & (F.col("start_ms") < o.guard_from_ms) & (seen > o.guard_shift_ms)
        out = scan.numbered(out, keys, "_n").withColumn("start_ms", F.when(early, F.least(seen, F.greatest(F.lit(0), F.col("end_ms") - o.min_ms))).otherwise(F.col("start_ms"))).drop("_n")
    return out.withColumn("end_ms", F.least(F.col("end_ms"), F.col("start_ms") + o.max_ms))


def separated(cues: DataFrame, o: Clean = Clean(), keys: Keys = ("video_id",)) -> DataFrame:
    """No cue starts before the one emitted before it has ended; cues then too short join that one.

    Each cue depends on what became of the last, which is no window function,
    but a fold that can be cut anywhere (``scan.deoverlapped``). A cue without
    a time moves nothing; one that joins another and ends before it starts
    counts as ending there.
    """
    out = written(scan.deoverlapped(cues, keys, o.min_ms, o.merge_short), "separated")
    tall = scan.counted(out, keys, "_k", "_n")
    if o.merge_short and not out.where(~F.col("_head")).isEmpty():
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"]), "")
        own = {c: F.min_by(c, "ord") for c in cues.columns if c not in keys}
        own |= {"end_ms": F.max("end_ms"), "text": F.when(F.count("*") == 1, F.min_by("text", "ord")).otherwise(joined)}
        tall = tall.groupBy(*keys, "_n").agg(*(v.alias(c) for c, v in own.items()))
    return tall.select(*cues.columns, "_n").withColumn("ord", F.col("_n")).withColumn("index", F.col("_n")).drop("_n")


def islands(cues: DataFrame, changed: Column, keys: Keys) -> DataFrame:
    """Numbers runs of consecutive cues: a new one where ``changed`` is true or null."""
    return cues.withColumn("run", F.sum(F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0)).over(track(keys)))


def repeated_runs(cues: DataFrame, o: Clean = Clean(), keys: Keys = ("video_id",)) -> DataFrame:
    """Adds ``run``, ``run_count``, ``run_span_ms`` and ``dropped``: a run of one text, often and long enough, goes."""
    # Read twice below, and once more by what renumbers the rest.
    tall = written(scan.runs(cues.withColumn("repeat_key", T.repeat_key(F.coalesce("text", F.lit("")))), keys, F.col("repeat_key")), "runs")
    each = tall.groupBy(*(F.col(c).alias(f"_r_{c}") for c in (*keys, "run"))).agg(F.count("*").alias("run_count"), (F.max_by("end_ms", "ord") - F.min_by("start_ms", "ord")).alias("run_span_ms"))
    same = F.col("run") == F.col("_r_run")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    tall = tall.join(each, same).drop(*(f"_r_{c}" for c in (*keys, "run")))
    return tall.withColumn("dropped", (F.col("repeat_key") != "") & (F.col("run_count") >= o.repeat_count) & (F.col("run_span_ms") >= o.repeat_span_ms))


def without_repeats(cues: DataFrame, o: Clean = Clean(), keys: Keys = ("video_id",)) -> DataFrame:
    return renumber(repeated_runs(cues, o, keys).where(~F.col("dropped")).select(*cues.columns), keys)


def visual_filter(cues: DataFrame, seen: DataFrame, min_ms: int = 700, ratio: float = 0.25, fail: bool = True, keys: Keys = ("video_id",)) -> DataFrame:
    """Drops cues whose middle shows no text by ``seen`` (keys, ``ord``, ``visible``).

    Short cues are not looked at. Where more than ``ratio`` of a track's would
    go, all stay, or with ``fail`` the query ends in an error.
    """
    w = Window.partitionBy(*keys)
    looked = F.col("looked")
    tall = cues.join(seen.select(*keys, "ord", "visible"), [*keys, "ord"], "left").withColumn("looked", duration() >= min_ms)
    gone = looked & ~F.coalesce("visible", F.lit(False))
    tall = tall.withColumn("gone", gone).withColumn("drop_ratio", F.coalesce(F.try_divide(F.sum(F.col("gone").cast("int")).over(w), F.sum(looked.cast("int")).over(w)), F.lit(0.0)))
    many = F.col("drop_ratio") > ratio
    if fail:
        tall = tall.withColumn("gone", F.when(many, F.raise_error(F.lit("too many cues have no visible text")).cast("boolean")).otherwise(F.col("gone")))
    kept = tall.where(many | ~F.col("gone")) if not fail else tall.where(~F.col("gone"))
    return renumber(kept.select(*cues.columns), keys)


def cleaned(cues: DataFrame, o: Clean = Clean(), keys: Keys = ("video_id",), visual_start: str | None = None) -> DataFrame:
    """The whole text path: blank cues go, marks become full-width, times are clamped and separated, repeats dropped."""
    extra = [visual_start] if visual_start else []
    out = solid(cues).withColumn("text", T.full_width(T.strip(F.col("text"))))
    return without_repeats(separated(clamped(out, o, keys, visual_start).drop(*extra), o, keys), o, keys)


def gaps(cues: DataFrame, o: Limits = Limits(), keys: Keys = ("video_id",)) -> DataFrame:
    """Silences longer than ``gap_ms`` between neighbours."""
    w = track(keys)
    tall = cues.select(*keys, "ord", F.lag("index").over(w).alias("after_index"), F.col("index").alias("before_index"), F.lag("end_ms").over(w).alias("gap_start_ms"), F.col("start_ms").alias("gap_end_ms"))
    return tall.withColumn("gap_ms", F.col("gap_end_ms") - F.col("gap_start_ms")).where(F.col("gap_ms") > o.gap_ms)


def quality(cues: DataFrame, o: Limits = Limits(), keys: Keys = ("video_id",)) -> DataFrame:
    """One report per track; short cues alone do not fail it."""
    w = track(keys)
    tall = cues.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(w)).withColumn("after", F.lag("index").over(w)).withColumn("before_end", F.lag("end_ms").over(w))
    wide, short, long = F.col("gap") > o.gap_ms, duration() < o.short_ms, duration() > o.long_ms
    item = F.struct("ord", "index", duration().alias("duration_ms"), "text")
    silence = F.struct("ord", F.col("after").alias("after_index"), F.col("index").alias("before_index"), F.col("before_end").alias("start_ms"), F.col("start_ms").alias("end_ms"), F.col("gap").alias("gap_ms"))
    # The lists are of the first few: rows are numbered within their kind, so no longer list is ever gathered.
    tall = tall.withColumns({"_g": F.sum(F.when(wide, 1)).over(w), "_s": F.sum(F.when(short, 1)).over(w), "_l": F.sum(F.when(long, 1)).over(w)})
    listed = lambda ok, n, most, what: F.sort_array(F.collect_list(F.when(ok & (F.col(n) <= most), what)))
    return tall.groupBy(*keys).agg(
        F.min_by("start_ms", "ord").alias("first_start_ms"),
        F.max_by("end_ms", "ord").alias("last_end_ms"),
        F.count("*").alias("subtitle_count"),
        F.count(F.when(wide, 1)).alias("large_gap_count"),
        F.count(F.when(short, 1)).alias("short_item_count"),
        F.count(F.when(long, 1)).alias("long_item_count"),
        listed(wide, "_g", o.gaps, silence).alias("large_gaps"),
        listed(short, "_s", o.items, item).alias("short_items"),
        listed(long, "_l", o.items, item).alias("long_items"),
        (F.count(F.when(wide | long, 1)) == 0).alias("passed"),
    )


def quality_score() -> Column:
    return F.col("large_gap_count") * 5 + F.col("long_item_count") * 4 + F.col("short_item_count")


def suspicious(cues: DataFrame, o: Limits = Limits(), keys: Keys = ("video_id",)) -> DataFrame:
    """Windows to look at again: a report's gaps, then its long, then its short cues, each in order and at most as many as it lists."""
    w = track(keys)

    def part(rows: DataFrame, kind: int, name: str, most: int) -> DataFrame:
        n = F.row_number().over(w)
        return rows.withColumn("place", n.cast("long")).where(F.col("place") <= most).select(*keys, F.lit(kind).alias("kind_no"), F.lit(name).alias("kind"), "place", "index", F.col("ms").cast("long").alias("ms"))

    found = gaps(cues, o, keys).select(*keys, "ord", F.col("before_index").alias("index"), F.col("gap_ms").alias("ms"))
    timed = cues.withColumn("ms", duration())
    return part(found, 1, "gap", o.gaps).unionByName(part(timed.where(F.col("ms") > o.long_ms), 2, "long", o.items)).unionByName(part(timed.where(F.col("ms") < o.short_ms), 3, "short", o.items))


def errors(cues: DataFrame, tracks: DataFrame | None = None, keys: Keys = ("video_id",)) -> DataFrame:
    """Basic faults as ``keys, ord, check_no, message``, in order. ``tracks`` (keys) adds those without a cue."""
    tall = scan.running(cues, keys, _n=("sum", F.lit(1).cast("long")), _last=("last", F.col("end_ms")))
    tall = tall.withColumn("_n", F.col("_n") + 1).withColumn("_before", F.when(F.col("_last").isNull(), -1).otherwise(F.col("_last.v")))
    where = F.concat(F.lit("index "), F.col("_n").cast("string"))
    checks = [
        (F.col("index") != F.col("_n"), F.concat(F.lit("index "), F.col("index").cast("string"), F.lit(" should be "), F.col("_n").cast("string"))),
        (T.is_blank(F.col("text")), F.concat(where, F.lit(" has empty text"))),
        (F.col("start_ms") >= F.col("end_ms"), F.concat(where, F.lit(" start time is not before end time"))),
        (F.col("start_ms") < F.col("_before"), F.concat(where, F.lit(" overlaps previous subtitle"))),
    ]
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(k).alias("check_no"), message.alias("message"))) for k, (bad, message) in enumerate(checks, 1))))
    out = tall.select(*keys, "ord", F.explode(found).alias("e")).select(*keys, "ord", "e.check_no", "e.message")
    if tracks is not None:
        empty = tracks.select(*keys).join(cues.select(*keys).distinct(), list(keys), "left_anti")
        out = out.unionByName(empty.select(*keys, F.lit(0).cast("long").alias("ord"), F.lit(5).alias("check_no"), F.lit("subtitle file has no valid items").alias("message")))
    return out


def bridged(chunks: DataFrame, gap: int, start: str = "start", end: str = "end", keys: Keys = ("video_id",)) -> DataFrame:
    """Joins chunks in order whose gap is at most ``gap``; a joined chunk ends where its last one does."""
    w = track(keys)
    tall = islands(chunks, F.col(start) - F.lag(end).over(w) > gap, keys)
    return tall.groupBy(*keys, "run").agg(F.min_by(start, "ord").alias(start), F.max_by(end, "ord").alias(end), F.count("*").alias("n_chunks"))


def timing(source: DataFrame, other: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """First start, last end, span and spoken time of two tracks, and whether they agree; an empty track counts as 0."""

    def half(cues: DataFrame, name: str) -> DataFrame:
        return cues.groupBy(*keys).agg(F.min_by("start_ms", "ord").alias(f"{name}_start_ms"), F.max_by("end_ms", "ord").alias(f"{name}_end_ms"), F.sum(F.greatest(F.lit(0), duration())).alias(f"{name}_total_ms"), F.count("*").alias(f"{name}_count"))

    both = half(source, "source").join(half(other, "en"), list(keys), "full")
    both = both.na.fill(0, [c for c in both.columns if c not in keys])
    for name in ("source", "en"):
        both = both.withColumn(f"{name}_span_ms", F.greatest(F.lit(0), F.col(f"{name}_end_ms") - F.col(f"{name}_start_ms")))
    return both.withColumns({
        "span_equal": (F.col("source_start_ms") == F.col("en_start_ms")) & (F.col("source_end_ms") == F.col("en_end_ms")),
        "total_time_equal": F.col("source_total_ms") == F.col("en_total_ms"),
        "count_equal": F.col("source_count") == F.col("en_count"),
    })


def low_confidence(segments: DataFrame, logprob: float = -1.0, silence: float = 0.85) -> DataFrame:
    """Segments with text that the recogniser was unsure of; a missing value counts as sure."""
    return segments.where(~T.is_blank(F.col("text")) & ((F.coalesce("avg_logprob", F.lit(0.0)) < logprob) | (F.coalesce("no_speech_prob", F.lit(0.0)) > silence)))


def from_segments(segments: DataFrame, dense: bool = False, keys: Keys = ("video_id",)) -> DataFrame:
    """Recogniser segments (seconds) as cues; indexes count all segments, or with ``dense`` those with text."""
    w = track(keys)
    numbered = segments.withColumn("index", F.row_number().over(w).cast("long"))
    out = numbered.where(~T.is_blank(F.col("text")))
    if dense:
        out = out.withColumn("index", F.row_number().over(w).cast("long"))
    ms = lambda c: (F.col(c) * 1000).cast("long")
    return out.select(*keys, "ord", "index", ms("start").alias("start_ms"), ms("end").alias("end_ms"), T.strip(F.col("text")).alias("text"))


def mean_confidence(segments: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """Mean word confidence of a track, four places; null without any."""
    words = segments.select(*keys, F.explode_outer("words").alias("w"))
    return words.groupBy(*keys).agg(F.bround(F.avg("w.confidence"), 4).alias("mean_confidence"))


def track_text(cues: DataFrame, most: int = 4500, keys: Keys = ("video_id",)) -> DataFrame:
    """A track's text by the line, blank ones left out, cut at ``most`` characters."""
    lines = solid(cues).select(*keys, "ord", T.collapse(F.col("text")).alias("line"))
    # Only the cues that reach into the cut are gathered.
    used = F.sum(F.length("line") + 1).over(track(keys).rowsBetween(Window.unboundedPreceding, -1))
    near = lines.withColumn("used", F.coalesce(used, F.lit(0))).where(F.col("used") <= most)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"])
    return near.groupBy(*keys).agg(F.substring(F.array_join(parts, "\n"), 1, most).alias("text"))
