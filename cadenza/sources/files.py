"""Files: listings, JSON documents, probe records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import timecode as C

#: Video suffixes that count as input.
SUFFIXES = (".mp4", ".mov", ".mkv")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir`` or the one set on the context; a local session that names none gets one of its own, on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="cadenza-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/cadenza/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder that all executors share and read back, so lineage is cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def videos(files: DataFrame, folder: str | None = None, single: str | None = None) -> DataFrame:
    """``files`` (``path`` and more) that are videos, in order of their paths: a single path alone where one is given, else what lies in ``folder`` itself, else all."""
    path = F.col("path")
    if single is not None:
        files = files.where(path == single)
    elif folder is not None:
        files = files.where(F.regexp_replace(path, r"/[^/]*$", "") == folder.rstrip("/"))
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*SUFFIXES)).orderBy("path")


def list_videos(spark: SparkSession, folder: str, single: str | None = None) -> DataFrame:
    """``path, length`` of a folder's videos in order, not of its subfolders; a single path comes first. File contents are not read."""
    where = single or folder
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, length long")
    return videos(spark.read.format("binaryFile").load(where).select("path", "length"))


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files of one JSON object, or of a list of them, by an explicit schema."""
    return spark.read.json(path, multiLine=True, schema=schema)


def probed(records: DataFrame, max_minutes: int = 10) -> DataFrame:
    """Video records from probe output: ``filename``, ``duration``, ``size`` and ``streams`` (codec_type, codec_name, width, height, r_frame_rate).

    The first video and the first audio stream count and both must be there;
    wrong suffixes and videos that are too long are left out.
    """
    pick = lambda kind: F.get(F.filter("streams", lambda s: s["codec_type"] == kind), F.lit(0))
    tall = records.withColumn("v", pick("video")).withColumn("a", pick("audio"))
    ok = F.col("v").isNotNull() & F.col("a").isNotNull() & (F.col("duration") <= max_minutes * 60) & F.lower(F.regexp_extract("filename", r"(\.[^./]*)$", 1)).isin(*SUFFIXES)
    return tall.where(ok).select("filename", "duration", F.col("v.width").alias("width"), F.col("v.height").alias("height"), C.frame_rate(F.col("v.r_frame_rate")).alias("fps"), F.lit(True).alias("has_audio"), F.col("v.codec_name").alias("video_codec"), F.col("a.codec_name").alias("audio_codec"), F.col("size").alias("file_size"), F.lit(True).alias("valid"))
