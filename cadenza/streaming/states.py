"""What jobs are at, kept up to date as their events arrive.

A job's state follows from a few maxima over its events, so it is a plain
streaming aggregation: Spark keeps the maxima of each job in its state store
and adds those of a micro-batch, however the events are split or late. The
same expression over a table of events gives the same rows at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks import replace

Keys = Sequence[str]


def live_states(events: DataFrame, order: Sequence[str], keys: Keys = ("video_id",)) -> DataFrame:
    """``keys, status, last_success_step, failed_step`` as ``operators.runs.job_states`` has them, for a table or a stream of events.

    ``order`` lists all steps: a success is held against the failed step by it.
    """
    status, seq, step = F.col("status"), F.col("seq"), F.col("step")
    is_ = status.isin
    last = lambda what, when: F.max(F.when(when, F.struct("seq", what.alias("x"))))
    job = F.when(is_("done"), "success").otherwise(status)
    won = [F.max(F.when(is_("success") & (step == s), seq)).alias(f"_won{i}") for i, s in enumerate(order)]
    out = events.groupBy(*keys).agg(
        F.max(F.when(is_("reset"), seq)).alias("_reset"),
        last(job, ~is_("success", "reset")).alias("_said"),
        last(step, is_("success")).alias("_won"),
        last(step, is_("failed")).alias("_failed"),
        F.max(F.when(is_("running", "done", "partial"), seq)).alias("_on"),
        *won,
    )
    # What is not newer than the last reset is forgotten; a maximum that is not newer hides nothing newer.
    since = lambda c: F.when(F.col("_reset").isNull() | (F.col(f"{c}.seq") > F.col("_reset")), F.col(c))
    failed = since("_failed")
    own = F.coalesce(*(F.when(failed["x"] == s, F.col(f"_won{i}")) for i, s in enumerate(order)), F.lit(None).cast(dict(out.dtypes)["_on"]))
    cleared = F.coalesce(F.col("_on") > failed["seq"], F.lit(False)) | F.coalesce(own > failed["seq"], F.lit(False))
    return out.select(*keys, F.coalesce(since("_said")["x"], F.lit("pending")).alias("status"), since("_won")["x"].alias("last_success_step"), F.when(~cleared, failed["x"]).alias("failed_step"))


def follow(events: DataFrame, order: Sequence[str], out: str, checkpoint: str, keys: Keys = ("video_id",), once: bool = False) -> StreamingQuery:
    """Writes the jobs that a micro-batch of the stream ``events`` changes under ``out``, each batch in a folder of its number that is put in place whole."""

    def put(batch: DataFrame, number: int) -> None:
        replace(batch.sparkSession, f"{out}/batch={number}", lambda to: batch.write.parquet(to))

    stream = live_states(events, order, keys).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def current(spark: SparkSession, out: str, keys: Keys = ("video_id",)) -> DataFrame:
    """Each job's row of the last batch that changed it."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
