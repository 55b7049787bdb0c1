"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one is set only where a local session names none."""
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
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/cadenza/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cadenza_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later result reads."""
    for t in tables:
        path = getattr(t, "_cadenza_path", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it is too small to fill them; a table of some size is left as it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if -(-size // split) * 2 < cores else df


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1 and so on: functions over batches take no name with a dot or a quote."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, in the types the operators take."""
    return spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
