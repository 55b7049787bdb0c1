"""Outside calls as rounds over a table of requests, so a run can be taken up again.

A request is known by the hash of its prompt, so equal ones are asked once.
Every round asks what is still open, in Arrow batches, and is written before
anything is read from it: a folder for each round, put in place by a rename. A
run that is cut short finds its finished rounds and goes on after them.

A transient failure makes a request due again at the same provider until the
policy's attempts are used up; then, or after any other failure, the next
provider is asked. What no provider answers gets the default.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sinks import replace
from ..sources.files import written
from .runs import Retry

#: Answers a prompt or fails; told which attempt it is, from 1.
Provider = Callable[[str, int], str]

_LOG = "request string, prompt string, provider int, attempt int, reply string, error string"


def keyed(prompts: DataFrame) -> DataFrame:
    """``prompts`` with ``request``, the hash of ``prompt``; a null prompt counts as empty."""
    return prompts.withColumn("request", F.sha2(F.coalesce("prompt", F.lit("")), 256))


def _asked(providers: Sequence[Provider]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            replies, errors = [], []
            for prompt, provider, attempt in zip(*(batch.column(c).to_pylist() for c in ("prompt", "provider", "attempt")), strict=True):
                reply, error = None, None
                try:
                    reply = providers[provider](prompt, attempt)
                except Exception as e:  # noqa: BLE001  whatever a provider raises is data here
                    error = str(e)
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("request", "prompt", "provider", "attempt")), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["request", "prompt", "provider", "attempt", "reply", "error"])

    return run


def rounds(spark: SparkSession, folder: str) -> int:
    """How many rounds are there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(s.getPath().getName().startswith("round=") for s in fs.listStatus(p)) if fs.exists(p) else 0


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Every call that was made: ``round, request, prompt, provider, attempt, reply, error``."""
    if not rounds(spark, folder):
        return spark.createDataFrame([], f"{_LOG}, round int")
    return spark.read.option("basePath", folder).schema(f"{_LOG}, round int").parquet(f"{folder}/round=*")


def _state(calls: DataFrame) -> DataFrame:
    """The last call of each request."""
    return calls.groupBy("request").agg(F.max(F.struct("round", "provider", "attempt", F.col("reply").isNotNull().alias("ok"), "reply", "error")).alias("s")).select("request", "s.*")


def _next(failed: DataFrame, providers: int, policy: Retry) -> DataFrame:
    """``request, prompt, provider, attempt`` of what is asked after calls that failed."""
    again = T.is_transient(F.col("error")) & (F.col("attempt") < policy.attempts)
    next_ = failed.select("request", "prompt", F.when(again, F.col("provider")).otherwise(F.col("provider") + 1).alias("provider"), F.when(again, F.col("attempt") + 1).otherwise(1).alias("attempt"))
    return next_.where(F.col("provider") < providers)


def _open(asked: DataFrame, calls: DataFrame, providers: int, policy: Retry) -> DataFrame:
    """``request, prompt, provider, attempt`` of what has to be asked now."""
    last = _state(calls).select(F.col("request").alias("_r"), "provider", "attempt", "ok", "error")
    both = asked.join(last, F.col("request") == F.col("_r"), "left").where(~F.coalesce("ok", F.lit(False)))
    new = both.where("_r IS NULL").select("request", "prompt", F.lit(0).alias("provider"), F.lit(1).alias("attempt"))
    return new.unionByName(_next(both.where("_r IS NOT NULL"), providers, policy))


def answered(prompts: DataFrame, providers: Sequence[Provider], folder: str, policy: Retry = Retry(), default: str | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``prompts`` (``prompt`` and more) with ``reply``, ``provider`` (from 0, null for the default), ``calls`` and ``error``, the last failure.

    ``folder`` keeps every call. There are as many rounds as a request can
    have attempts, at most. Rows whose prompts are equal share an answer; a
    provider that returns nothing has answered with an empty text.

    What is open is found by a join once, when a run begins or is taken up: a
    round asks all that is open, so what failed in it is what the next one has
    to ask, and no round goes over the prompts or the earlier rounds again.
    """
    spark = prompts.sparkSession
    asked = keyed(prompts).select("request", F.coalesce("prompt", F.lit("")).alias("prompt")).distinct()
    waits = [max(0.0, policy.seconds * policy.factor**k) for k in range(policy.attempts)]
    safe = [lambda p, k, one=one: one(p, k) or "" for one in providers]
    done = rounds(spark, folder)
    if done:
        now = written(_open(asked, log(spark, folder), len(providers), policy), "open")
    else:
        now = asked.select("request", "prompt", F.lit(0).alias("provider"), F.lit(1).alias("attempt")).where(F.col("provider") < len(providers))
    # Of a first round it is known without a look that all are first attempts.
    most = now.agg(F.max("attempt").alias("k")).first()["k"] if done else (1 if providers and not prompts.isEmpty() else None)
    while most is not None:
        if most > 1:
            sleep(waits[most - 2])
        path = f"{folder}/round={rounds(spark, folder)}"
        replace(spark, path, lambda to: now.mapInArrow(_asked(safe), _LOG).write.parquet(to))  # noqa: B023  called at once
        now = _next(spark.read.schema(_LOG).parquet(path).where("reply IS NULL"), len(providers), policy)
        most = now.agg(F.max("attempt").alias("k")).first()["k"]
    calls = log(spark, folder)
    state = F.max(F.struct("round", "provider", F.col("reply").isNotNull().alias("ok"), "reply"))
    failure = F.max(F.when(F.col("error").isNotNull(), F.struct("round", "error")))["error"]
    last = calls.groupBy("request").agg(state.alias("s"), F.count("*").alias("calls"), failure.alias("failure")).select("s.*", "request", "calls", "failure")
    told = last.select(F.col("request").alias("_r"), F.coalesce("reply", F.lit(default)).alias("reply"), F.when(F.col("ok"), F.col("provider")).alias("provider"), "calls", F.col("failure").alias("error"))
    return keyed(prompts).join(told, F.col("request") == F.col("_r")).drop("_r", "request")
