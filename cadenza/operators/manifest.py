"""Outputs of a step kept over runs: only inputs that changed are worked on again.

A folder holds the rows that each run made (``made/run=n``) and, after it, a
manifest of what every input looked like when its rows were made
(``manifest/run=n``). A manifest is written aside and renamed, so a run counts
only once all it made is there; what an unfinished run left is written over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import replace

#: What an input looks like: its content's hash where it is known, else its size and time.
FINGERPRINT = ("size", "modified", "hash")


def _path(spark: SparkSession, *parts: str):
    p = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def last_run(spark: SparkSession, folder: str) -> int:
    """Number of the last run that was finished, 0 if there is none."""
    p, fs = _path(spark, folder, "manifest")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n[4:]) for n in names if n.startswith("run=")), default=0)


def manifest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame | None:
    """``keys, size, modified, hash, made`` as of the last finished run; ``made`` is the run that made an input's rows."""
    run = last_run(spark, folder)
    return spark.read.parquet(f"{folder}/manifest/run={run}").select(*keys, *FINGERPRINT, "made") if run else None


def _same(keys: Sequence[str]) -> Column:
    """Whether an input looks as the manifest (columns ``_m_...``) has it."""
    hashed = F.col("hash").isNotNull() & F.col("_m_hash").isNotNull()
    told = (F.col("size") == F.col("_m_size")) & (F.col("modified") == F.col("_m_modified"))
    same = F.when(hashed, F.col("hash") == F.col("_m_hash")).otherwise(F.coalesce(told, F.lit(False)))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return same


def due(inputs: DataFrame, known: DataFrame | None, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """``inputs`` (``keys``, ``size``, ``modified``, ``hash`` and more) that are new or look other than in ``known``; all with ``overwrite``."""
    if known is None or overwrite:
        return inputs
    return inputs.join(known.select(*(F.col(c).alias(f"_m_{c}") for c in (*keys, *FINGERPRINT))), _same(keys), "left_anti")


def run(inputs: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("name",), overwrite: bool = False) -> int:
    """Rows of ``work`` for the inputs that are due, and a new manifest; returns the run's number.

    ``work`` returns rows with ``keys``. Inputs are one row a key. If none is
    due and none has gone, nothing is written and the last run's number is
    returned; if ``work`` fails, the folder is as after the last run.
    """
    spark = inputs.sparkSession
    known, number = manifest(spark, folder, keys), last_run(spark, folder) + 1
    todo = due(inputs, known, keys, overwrite)
    if known is not None and todo.isEmpty():
        gone = known.join(inputs.select(*(F.col(k).alias(f"_i_{k}") for k in keys)), _keyed(keys, "_i_"), "left_anti")
        if gone.isEmpty():
            return number - 1
    # An unfinished run of this number may have left rows.
    replace(spark, f"{folder}/made/run={number}", lambda to: work(todo).write.parquet(to))
    now = inputs.select(*keys, *FINGERPRINT)
    if known is None or overwrite:
        now = now.withColumn("made", F.lit(number))
    else:
        before = known.select(*(F.col(c).alias(f"_m_{c}") for c in (*keys, *FINGERPRINT)), F.col("made").alias("_made"))
        now = now.join(before, _same(keys), "left").select(*keys, *FINGERPRINT, F.coalesce("_made", F.lit(number)).alias("made"))
    replace(spark, f"{folder}/manifest/run={number}", lambda to: now.write.parquet(to))
    return number


def _keyed(keys: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(prefix + k))
    return same


def outputs(spark: SparkSession, folder: str, keys: Sequence[str] = ("name",)) -> DataFrame:
    """The rows of every input of the last finished run, each from the run that made them last, with ``made``."""
    known = manifest(spark, folder, keys)
    if known is None:
        raise ValueError(f"no run of {folder} was finished")
    rows = spark.read.option("basePath", f"{folder}/made").parquet(f"{folder}/made")
    use = known.select(*(F.col(k).alias(f"_m_{k}") for k in keys), "made")
    return rows.join(use, _keyed(keys, "_m_") & (F.col("run") == F.col("made"))).drop("run", *(f"_m_{k}" for k in keys))
