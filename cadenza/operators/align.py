"""Alignment of two tracks, by key with a fall back to the position."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .cues import track

Keys = Sequence[str]


@dataclass(frozen=True)
class EnCheck:
    max_lines: int = 2
    max_line_chars: int = 42
    max_cps: float = 17.0


def last_of_index(cues: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """Of cues with one index the last in order."""
    row = F.struct(*(c for c in ("ord", *[c for c in cues.columns if c not in (*keys, "ord", "index")])))
    return cues.groupBy(*keys, "index").agg(F.max(row).alias("r")).select(*keys, "index", "r.*")


def aligned(source: DataFrame, other: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """Every source cue with the other track's text of its index, else of its position; ``matched`` is index, position or null."""
    by_index = last_of_index(other, keys).select(*keys, "index", F.struct("text").alias("i"))
    by_place = other.select(*keys, F.row_number().over(track(keys)).alias("place"), F.struct("text").alias("p"))
    tall = source.withColumn("place", F.row_number().over(track(keys)))
    tall = tall.join(by_index, [*keys, "index"], "left").join(by_place, [*keys, "place"], "left")
    # The whole row falls through, not its text: an empty text that matches stays.
    chosen = F.coalesce("i", "p")["text"]
    how = F.when(F.col("i").isNotNull(), "index").when(F.col("p").isNotNull(), "position")
    return tall.select(*keys, "ord", "index", "start_ms", "end_ms", T.strip(chosen).alias("text"), how.alias("matched"))


def strict(out: DataFrame) -> DataFrame:
    """Ends the query at a cue without a partner."""
    missing = F.raise_error(F.concat(F.lit("Missing translation for subtitle index "), F.col("index").cast("string"))).cast("string")
    return out.withColumn("text", F.when(F.col("matched").isNull(), missing).otherwise(F.col("text")))


def missing_keys(source: DataFrame, other: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    return source.join(other.select(*keys, "index"), [*keys, "index"], "left_anti")


def repaired_chunks(source: DataFrame, other: DataFrame, single: DataFrame, keys: Keys = ("video_id",), chunk: int = 20) -> DataFrame:
    """Chunks of equal size as they are, others by index with ``single`` (keys, index, text) for what is missing."""
    tall = chunked(source, keys, chunk)
    mine = chunked(other, keys, chunk)
    by = [*keys, "chunk"]
    sizes = tall.groupBy(*by).agg(F.count("*").alias("n")).join(mine.groupBy(*by).agg(F.count("*").alias("m")), by, "left")
    ok = sizes.select(*by, (F.col("n") == F.coalesce("m", F.lit(0))).alias("whole"))
    as_is = mine.join(ok.where("whole"), by, "left_semi").select(*keys, "chunk", "place", "text", F.lit("chunk").alias("origin"))
    broken = tall.join(ok.where("NOT whole"), by, "left_semi")
    found = last_of_index(mine.drop("place"), (*keys, "chunk")).select(*by, "index", F.col("text").alias("found"), F.lit(True).alias("there"))
    fixed = broken.join(found, [*by, "index"], "left").join(single.select(*keys, "index", F.col("text").alias("one")), [*keys, "index"], "left")
    fixed = fixed.select(*keys, "chunk", "place", F.when(F.col("there"), F.col("found")).otherwise(F.col("one")).alias("text"), F.when(F.col("there"), "index").otherwise("single").alias("origin"))
    return as_is.unionByName(fixed)


def chunked(cues: DataFrame, keys: Keys = ("video_id",), size: int = 20) -> DataFrame:
    """Adds ``chunk`` and ``place`` within it, both from 1, in order."""
    n = F.row_number().over(track(keys)) - 1
    return cues.withColumn("chunk", F.floor(n / size) + 1).withColumn("place", (n % size + 1).cast("long"))


def is_bad(text: Column) -> Column:
    t = T.strip(F.coalesce(text, F.lit("")))
    return (t == "") | t.contains(T.PLACEHOLDER) | T.has_cjk(t)


def translation_errors(cues: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """Up to three messages a cue, in order."""
    t = T.strip(F.coalesce("text", F.lit("")))
    at = F.concat(F.lit("index "), F.col("index").cast("string"))
    checks = [(t == "", " has empty translation"), (t.contains(T.PLACEHOLDER), " uses placeholder translation"), (T.has_cjk(t), " still contains Chinese text")]
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(k).alias("check_no"), F.concat(at, F.lit(m)).alias("message"))) for k, (bad, m) in enumerate(checks, 1))))
    return cues.select(*keys, "ord", F.explode(found).alias("e")).select(*keys, "ord", "e.check_no", "e.message")


def repaired(cues: DataFrame, fixes: DataFrame, source: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """Bad texts replaced by ``fixes`` (keys, index, text); indexes the source lacks are left alone."""
    known = fixes.join(source.select(*keys, "index"), [*keys, "index"], "left_semi").select(*keys, "index", F.col("text").alias("fix"))
    out = cues.join(known, [*keys, "index"], "left")
    return out.withColumn("text", F.when(is_bad(F.col("text")), F.coalesce("fix", "text")).otherwise(F.col("text"))).drop("fix")


def zipped(source: DataFrame, other: DataFrame, how: str = "inner", keys: Keys = ("video_id",)) -> DataFrame:
    """Pairs by position: ``s_`` and ``o_`` columns."""
    half = lambda d, p: d.select(*keys, F.row_number().over(track(keys)).cast("long").alias("place"), *(F.col(c).alias(p + c) for c in ("index", "start_ms", "end_ms", "text")))
    return half(source, "s_").join(half(other, "o_"), [*keys, "place"], how)


def checked(source: DataFrame, other: DataFrame, o: EnCheck = EnCheck(), keys: Keys = ("video_id",)) -> DataFrame:
    """The other track with the source's times and balanced lines; ``warnings`` in order, ``garbled``."""
    z = zipped(source, other, "inner", keys)
    text = T.rebalance(F.col("o_text"), o.max_line_chars)
    at = F.concat(F.lit("index "), F.col("place").cast("string"))
    z = z.withColumn("text", text).withColumn("cps", T.chars_per_second(F.col("text"), F.col("s_start_ms"), F.col("s_end_ms")))
    moved = (F.col("o_start_ms") != F.col("s_start_ms")) | (F.col("o_end_ms") != F.col("s_end_ms"))
    warnings = F.array_compact(F.array(
        F.when(moved, F.concat(at, F.lit(" time adjusted to source"))),
        F.when(F.size(T.lines_of(F.col("o_text"))) > o.max_lines, F.concat(at, F.lit(f" has more than {o.max_lines} lines"))),
        F.when(F.col("cps") > o.max_cps, F.concat(at, F.lit(" cps exceeds limit"))),
    ))
    return z.select(*keys, F.col("place").alias("ord"), F.col("o_index").alias("index"), F.col("s_start_ms").alias("start_ms"), F.col("s_end_ms").alias("end_ms"), "text", "cps", warnings.alias("warnings"), T.is_garbled(F.col("text")).alias("garbled"))


def placeholder(cues: DataFrame) -> DataFrame:
    return cues.withColumn("text", F.lit(T.PLACEHOLDER))


def accepted(source: DataFrame, checked_: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """The checked track where it has as many cues as the source, else the source itself."""
    n = lambda d, c: d.groupBy(*keys).agg(F.count("*").alias(c))
    ok = n(source, "n").join(n(checked_, "m"), list(keys)).where("n = m").select(*keys)
    return checked_.join(ok, list(keys), "left_semi").unionByName(source.join(ok, list(keys), "left_anti"))
