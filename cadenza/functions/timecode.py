"""Time codes. Times are integer milliseconds; text exists at the file boundary only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"


def srt_ms(text: Column) -> Column:
    """``HH:MM:SS,mmm`` to milliseconds; null for anything else."""
    part = lambda at, n: F.substring(text, at, n).try_cast("long")
    return F.when(text.rlike(f"^{TIME}$"), ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)) * 1000 + part(10, 3))


def srt_time(ms: Column) -> Column:
    """Milliseconds, at least 0, to ``HH:MM:SS,mmm``; hours may take more digits."""
    t = F.greatest(F.lit(0), ms.cast("long"))
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000))


def ass_time(ms: Column) -> Column:
    """Milliseconds to ``H:MM:SS.cc``; centiseconds round half to even and are at least 0."""
    t = F.greatest(F.lit(0), F.bround(ms / F.lit(10.0), 0).cast("long"))
    return F.when(ms.isNotNull(), F.format_string("%d:%02d:%02d.%02d", F.floor(t / 360_000), F.floor(t / 6000) % 60, F.floor(t / 100) % 60, t % 100))


def chunk_seconds(sample: Column, rate: Column) -> Column:
    """Audio samples to seconds with three places, half to even."""
    return F.bround(sample.cast("double") / rate, 3)


def frame_rate(text: Column) -> Column:
    """``a/b`` or a number to frames a second with three places; a zero divisor gives 0."""
    a, b = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    quotient = F.when(b.try_cast("double") == 0, F.lit(0.0)).otherwise(F.bround(F.try_divide(a.try_cast("double"), b.try_cast("double")), 3))
    return F.when(text.contains("/"), quotient).otherwise(text.try_cast("double"))


def frame_number(second: Column, fps: Column, frames: Column | None = None) -> Column:
    """The frame at a second, at least 0; with a count, at most the last."""
    n = F.floor(second * fps).cast("long")
    if frames is not None:
        n = F.least(frames - 1, n)
    return F.greatest(F.lit(0).cast("long"), n)
