"""Timed-text files as cue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import TIME, srt_ms

_LINE = rf"^({TIME})\s*-->\s*({TIME})"


def parse_srt(files: DataFrame, text: Column | str = "text", keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Cues of SRT texts (one row per file) with ``keys``.

    Blocks are cut at blank lines; one with fewer than three lines or without a
    time line is left out; a first line that is no integer gives way to the
    number of blocks accepted so far and one.
    """
    raw = F.col(text) if isinstance(text, str) else text
    whole = F.regexp_replace(F.regexp_replace(T.strip(F.regexp_replace(raw, "^﻿", "")), "\r\n", "\n"), "\r", "\n")
    blocks = files.select(*keys, F.posexplode(F.split(whole, r"(?U)\n\s*\n")).alias("block", "b"))
    lines = F.transform(F.filter(F.split("b", "\n"), lambda x: T.strip(x) != ""), T.rstrip)
    tall = blocks.withColumn("lines", lines).where(F.size("lines") >= 3)
    head = T.strip(F.get("lines", F.lit(0)))
    tall = tall.withColumn("_line", T.strip(F.get("lines", F.lit(1)))).where(F.col("_line").rlike(_LINE))
    # columns of their own: a time is read from its text many times over, which is matched once so
    tall = tall.withColumns({"_from": F.regexp_extract("_line", _LINE, 1), "_to": F.regexp_extract("_line", _LINE, 6)})
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("block"))
    index = F.when(head.rlike(r"^[+-]?\d+$"), head.try_cast("long"))
    return tall.select(
        *keys,
        n.cast("long").alias("ord"),
        F.coalesce(index, n.cast("long")).alias("index"),
        srt_ms(F.col("_from")).alias("start_ms"),
        srt_ms(F.col("_to")).alias("end_ms"),
        T.strip(F.array_join(F.slice("lines", 3, F.size("lines")), "\n")).alias("text"),
    )


def stem(path: Column) -> Column:
    """A file's name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all SRT files under ``path``; ``video_id`` is the whole path, so equal names do not meet."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("video_id"), F.col("value").alias("text"))
    return parse_srt(files)


def read_packed_srt(spark: SparkSession, path: str, keys: str = "video_id string") -> DataFrame:
    """Cues of SRT documents that ``sinks.write_packed`` has written under ``path``; ``keys`` is their schema, and keys stand for one document. A line that cannot be read is an error."""
    documents = spark.read.option("maxStringLen", 2**31 - 1).json(path, schema=f"{keys}, content string", mode="FAILFAST")
    return parse_srt(documents, "content", tuple(c for c in documents.columns if c != "content"))


def parse_reply(replies: DataFrame, text: str = "text", keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Cues of SRT that a model may have put into a code fence."""
    return parse_srt(replies.withColumn("_t", T.unfence(F.col(text))), "_t", keys)
