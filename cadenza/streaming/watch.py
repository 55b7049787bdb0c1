"""Cue files as they arrive: a folder watched, each batch cleaned as in batch mode.

The batch operators take a track as a whole, and a file is a track, so each
micro-batch of files can go through them unchanged. No event-time state is
kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cues import cleaned
from ..sources.subtitles import parse_srt


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = cleaned, once: bool = False) -> StreamingQuery:
    """Writes the cues of every new file of ``folder`` as Parquet under ``out``, each batch in a folder of its own number, so a batch run again replaces itself."""
    files = spark.readStream.schema("value string").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("video_id"), F.col("value").alias("text"))

    def put(batch: DataFrame, number: int) -> None:
        work(parse_srt(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
