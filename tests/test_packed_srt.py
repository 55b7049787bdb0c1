import glob

from pyspark.sql import functions as F

from cadenza import sinks as K
from cadenza.plans.file_queries import s3_read_srt
from cadenza.sources.subtitles import read_packed_srt


def packed(spark):
    return set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/cadenza/srt-*"))


def test_many_tracks_in_few_files(spark, tmp_path):
    """No file for each track; a track without a name keeps it."""
    user = F.when(F.col("id") % 300 != 7, F.col("id") % 300)
    events = spark.range(0, 900, 1, 3).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 5000).cast("timestamp_ntz").alias("ts"), user.alias("user_id"), F.when(F.col("id") < 600, "a\\ \"b\x1e").otherwise("").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    before = packed(spark)
    got = s3_read_srt(spark, str(tmp_path))
    (path,) = packed(spark) - before
    assert len(glob.glob(f"{path}/**/part-*", recursive=True)) <= 4
    assert {tuple(r) for r in got.collect()} == {(None if i % 300 == 7 else str(i % 300), 1 + i // 300, i * 1000, i * 1000 + 100, "a\\ \"b\x1e") for i in range(600)}


def test_long_track(spark, tmp_path):
    """A document of any length is read whole: 20 million characters are JSON's limit by default."""
    cue = spark.range(1).select(F.lit("v").alias("video_id"), F.lit(1).alias("ord"), F.lit(0).alias("start_ms"), F.lit(9).alias("end_ms"), F.expr("repeat('word ', 4100000)").alias("text"))
    K.write_packed(K.srt(cue), str(tmp_path / "p"))
    assert read_packed_srt(spark, str(tmp_path / "p")).select("video_id", "ord", F.length("text")).collect() == [("v", 1, 20_499_999)]
