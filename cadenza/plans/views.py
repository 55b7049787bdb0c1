"""Deterministic views of the driver tables as interval data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bands as B


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cues(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as the cues of a video."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 5000000")
    e = table(spark, d, "events").select(F.col("user_id").alias("video_id"), "event_id", start.alias("start_ms"), "value", F.col("event_type").alias("text"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start_ms", "event_id")).cast("long")
    return e.select("video_id", n.alias("ord"), n.alias("index"), "start_ms", (F.col("start_ms") + (F.col("value") * 100).cast("long")).alias("end_ms"), "text")


CUES = """cues AS (
  SELECT video_id, row_number() OVER w AS ord, row_number() OVER w AS "index", start_ms, start_ms + trunc(value * 100)::BIGINT AS end_ms, text
  FROM (SELECT user_id AS video_id, event_id, (epoch_us(ts) - 1704067200000000) // 5000000 AS start_ms, value, event_type AS text FROM events)
  WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, event_id))"""


def other(spark: SparkSession, d: str) -> DataFrame:
    """A second track made from the first: cues missing, indexes shifted so that some are double, texts spoilt."""
    o = F.col("ord")
    text = F.when(o % 11 == 0, " ").when(o % 6 == 0, F.concat("text", F.lit("你"))).when(o % 13 == 0, "[Translation unavailable]").when(o % 9 == 0, F.concat("text", F.lit("�"))).otherwise(F.concat("text", F.lit(" spoken in a rather long line\nof words that need a wrap at forty two characters")))
    rows = cues(spark, d).where(o % 7 != 0)
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("ord")).cast("long")
    return rows.select("video_id", n.alias("ord"), (F.col("index") + F.when(o % 5 == 0, 1).otherwise(0)).alias("index"), (F.col("start_ms") + F.when(o % 4 == 0, 10).otherwise(0)).alias("start_ms"), "end_ms", text.alias("text"))


OTHER = """other AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS ord, "index" + CASE WHEN ord % 5 = 0 THEN 1 ELSE 0 END AS "index",
    start_ms + CASE WHEN ord % 4 = 0 THEN 10 ELSE 0 END AS start_ms, end_ms,
    CASE WHEN ord % 11 = 0 THEN ' ' WHEN ord % 6 = 0 THEN text || '你' WHEN ord % 13 = 0 THEN '[Translation unavailable]' WHEN ord % 9 = 0 THEN text || chr(65533)
         ELSE text || ' spoken in a rather long line' || chr(10) || 'of words that need a wrap at forty two characters' END AS text
  FROM cues WHERE ord % 7 <> 0)"""


def found(spark: SparkSession, d: str) -> DataFrame:
    """Bands of frames: an order is a frame of 720 by 1280, its lines are the bands."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), n.alias("ord"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    x1 = 20 + F.col("l_partkey") % 260
    y1 = 300 + (F.col("l_suppkey") * 37 + F.col("ord") * 11) % 700
    return li.select((F.col("frame_id") % 97).alias("video_id"), "frame_id", "ord", F.lit(720).cast("long").alias("frame_width"), F.lit(1280).cast("long").alias("frame_height"), B.box(x1, y1, x1 + 60 + F.col("q") * 9, y1 + 20 + F.col("q") % 40, F.col("q") % 17).alias("b"))


FOUND = """found AS (
  SELECT frame_id % 97 AS video_id, frame_id, ord, 720 AS frame_width, 1280 AS frame_height, x1, y1, x1 + 60 + q * 9 AS x2, y1 + 20 + q % 40 AS y2,
    60 + q * 9 AS width, 20 + q % 40 AS height, q % 17 AS n
  FROM (SELECT *, 300 + (l_suppkey * 37 + ord * 11) % 700 AS y1 FROM (SELECT l_orderkey AS frame_id, l_suppkey, l_quantity::BIGINT AS q, 20 + l_partkey % 260 AS x1,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord FROM lineitem)))"""


def components(spark: SparkSession, d: str) -> DataFrame:
    """Letters of frames: lines of seven orders share a frame."""
    li = table(spark, d, "lineitem")
    x1 = (F.col("l_partkey") * 13) % 640
    y1 = (400 + (F.col("l_orderkey") % 7 * 3 + F.floor(F.col("l_orderkey") / 7) % 3 * 40)).cast("long")
    w, h = (3 + F.col("l_quantity").cast("long") % 30), (8 + F.col("l_linenumber") * 2).cast("long")
    return li.select((F.floor(F.col("l_orderkey") / 28)).cast("long").alias("frame_id"), F.lit(720).cast("long").alias("frame_width"), F.lit(1280).cast("long").alias("frame_height"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"), (w * h).alias("area")).withColumn("video_id", F.col("frame_id") % 97)


COMPONENTS = """components AS (
  SELECT frame_id % 97 AS video_id, frame_id, 720 AS frame_width, 1280 AS frame_height, x1, y1, x1 + w AS x2, y1 + h AS y2, w * h AS area
  FROM (SELECT l_orderkey // 28 AS frame_id, (l_partkey * 13) % 640 AS x1, 400 + l_orderkey % 7 * 3 + l_orderkey // 7 % 3 * 40 AS y1,
          3 + l_quantity::BIGINT % 30 AS w, 8 + l_linenumber * 2 AS h FROM lineitem))"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Runs: a customer's orders in order, six to a job, are its steps."""
    o = table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "failed").when(k % 7 == 0, None).otherwise("success")
    tall = o.select(F.col("o_custkey"), (n - 1).alias("n"), k)
    tall = tall.select((F.col("o_custkey") * 1_000_000 + F.floor(F.col("n") / 6)).cast("long").alias("video_id"), (F.col("n") % 6 + 1).alias("ord"), k)
    return tall.select("video_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("step"), (k % 11 != 0).alias("enabled"), (k % 23 == 0).alias("overwrite"), status.alias("status"), F.concat(F.lit("h"), (k % 2).cast("string")).alias("stored_hash"), F.when(k % 13 == 0, "hx").otherwise(F.concat(F.lit("h"), (k % 2).cast("string"))).alias("hash"))


STEPS = """steps AS (
  SELECT video_id, ord, 's' || ord AS step, k % 11 <> 0 AS enabled, k % 23 = 0 AS overwrite,
    CASE WHEN k % 5 = 0 THEN 'failed' WHEN k % 7 = 0 THEN NULL ELSE 'success' END AS status, 'h' || (k % 2) AS stored_hash,
    CASE WHEN k % 13 = 0 THEN 'hx' ELSE 'h' || (k % 2) END AS hash
  FROM (SELECT o_custkey * 1000000 + n // 6 AS video_id, n % 6 + 1 AS ord, o_orderkey AS k
        FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)))"""
