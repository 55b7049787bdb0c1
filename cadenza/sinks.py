"""Tables as timed-text files and reports."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.timecode import ass_time, srt_time
from .operators.cues import renumber, track
from .operators.align import zipped

Keys = Sequence[str]


def _document(rows: DataFrame, keys: Keys, part: str, between: str, head: Column, tail: str) -> DataFrame:
    """One text per key; a file is one row, so its parts have to come together."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", part))), lambda s: s[part])
    return rows.groupBy(*keys).agg(F.concat(head, F.array_join(parts, between), F.lit(tail)).alias("content"))


def srt(cues: DataFrame, keys: Keys = ("video_id",)) -> DataFrame:
    """``content`` per track: blocks numbered anew from 1, parted by blank lines, a line feed at the end."""
    block = F.concat(F.col("ord").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), T.strip(F.col("text")))
    return _document(renumber(cues, keys).withColumn("block", block), keys, "block", "\n\n", F.lit(""), "\n")


@dataclass(frozen=True)
class Style:
    font: str = "Arial"
    size: int = 38
    margin: int = 80
    outline: int = 2
    width: int = 1080
    height: int = 1920


#: The file's sections and fields.
_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: %d
PlayResY: %d
WrapStyle: 2
ScaledBorderAndShadow: yes
YCbCr Matrix: TV.709

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,%s,%d,&H00FFFFFF,&H00FFFFFF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,%d,1,2,40,40,%d,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def ass_header(s: Style = Style(), width: Column | None = None, height: Column | None = None, size: Column | None = None, margin: Column | None = None, outline: Column | None = None) -> Column:
    """The header for a style; a column stands for the style's value where it is not null."""
    own = lambda c, v: F.lit(v) if c is None else F.coalesce(c, F.lit(v))
    return F.format_string(_HEAD, own(width, s.width), own(height, s.height), F.lit(s.font), own(size, s.size), own(outline, s.outline), own(margin, s.margin))


def ass_events(cues: DataFrame, second: DataFrame | None = None, places: DataFrame | None = None, keys: Keys = ("video_id",)) -> DataFrame:
    """One ``line`` per cue in order; with ``second`` its text of the same position stands above, with ``places`` (keys, ``ord``, ``override``) a position tag before it."""
    if second is not None:
        rows = zipped(cues, second, "left", keys).select(*keys, F.col("place").alias("ord"), F.col("s_start_ms").alias("start_ms"), F.col("s_end_ms").alias("end_ms"), F.col("s_text").alias("text"), F.col("o_text").alias("above"))
    else:
        rows = cues.withColumn("ord", F.row_number().over(track(keys)).cast("long")).withColumn("above", F.lit(None).cast("string"))
    if places is not None:
        rows = rows.join(places.select(*keys, "ord", "override"), [*keys, "ord"], "left")
    else:
        rows = rows.withColumn("override", F.lit(""))
    own = T.ass_escape(F.col("text"))
    text = F.when(F.col("above").isNotNull(), F.concat(T.ass_escape(F.col("above")), F.lit(r"\N"), own)).otherwise(own)
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), F.coalesce("override", F.lit("")), text)
    return rows.select(*keys, "ord", line.alias("line"))


def ass(events: DataFrame, style: Style = Style(), keys: Keys = ("video_id",)) -> DataFrame:
    """``content`` per track, with a byte order mark."""
    return _document(events, keys, "line", "\n", F.concat(F.lit("﻿"), ass_header(style)), "\n")


def replace(spark: SparkSession, path: str, write: Callable[[str], None], tries: int = 5, wait: float = 0.4, sleep: Callable[[float], None] = time.sleep) -> None:
    """``write`` fills a new folder beside ``path``, which then takes its place.

    Until the new folder is whole the old one stays as it is, and a failed
    write leaves nothing behind. The exchange is two renames, tried again a few
    times with growing waits; if the second fails for good, the old folder is
    put back. A folder that an exchange cut short has left aside is put back
    by the next one.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = lambda kind: spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{kind}")
    old, new = beside("old"), beside(f"new-{uuid.uuid4().hex}")

    def moved(source, target) -> None:
        for k in range(tries):
            if fs.rename(source, target):
                return
            if k + 1 < tries:
                sleep(wait * (k + 1))
        raise OSError(f"{source} could not be renamed to {target}")

    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            moved(old, at)
    fs.mkdirs(at.getParent())
    try:
        write(new.toString())
        had = fs.exists(at)
        if had:
            moved(at, old)
        try:
            moved(new, at)
        except Exception:
            if had:
                fs.rename(old, at)
            raise
        fs.delete(old, True)
    except Exception:
        fs.delete(new, True)
        raise


def write_texts(documents: DataFrame, path: str) -> None:
    """Contents as text files by key; whole files replace those that were there. The writer adds the last line feed itself."""
    keys = [c for c in documents.columns if c != "content"]
    rows = documents.select(*keys, F.regexp_replace("content", r"\n\z", "").alias("value"))
    replace(documents.sparkSession, path, lambda to: rows.write.partitionBy(*keys).text(to))


def write_packed(documents: DataFrame, path: str) -> None:
    """Contents with their keys as JSON lines, many to a file, so files, and what lists and opens them, grow with the bytes and not with the tracks; whole files replace those that were there."""
    replace(documents.sparkSession, path, lambda to: documents.write.json(to))


def write_documents(documents: DataFrame, path: str, bits: int = 10) -> None:
    """JSON texts (``document``) as files that hold a list of up to 2 to the ``bits`` of them each, so files, and what lists and opens them, stay few."""
    numbered = documents.select("document", F.shiftright(F.monotonically_increasing_id(), bits).alias("file"))
    lists = numbered.groupBy("file").agg(F.collect_list("document").alias("d"))
    text = F.concat(F.lit("[\n"), F.array_join("d", ",\n"), F.lit("\n]"))
    replace(documents.sparkSession, path, lambda to: lists.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(to))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines; whole files replace those that were there."""
    replace(reports.sparkSession, path, lambda to: reports.write.json(to))
