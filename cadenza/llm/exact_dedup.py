"""Exact duplicates: 128-bit content hash groups with bytes compared inside them.

Only DataFrame functions run here. The grouping key is the hash together with
the normalised text itself, so Spark's aggregation compares the bytes of equal
hashes and two texts that collide stay apart. Copies collapse on the map side,
before the shuffle, so one text may hold any share of the rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import table

#: Fixed value: the characters that equality ignores.
IGNORED = r"[\x20\x09-\x0D]+"


def _hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, ignored: str = IGNORED) -> DataFrame:
    """The row that stays for every document of ``docs`` (``doc_id`` long, ``text``; more columns are ignored).

    Texts are equal when identical without ``ignored``; null counts as empty.
    The row with the most code points in its original text stays, then the
    smallest id. Returns one row per input row: ``doc_id, keep_id, group_size,
    kept, text_sha256``. A row with a null id ranks after all others of its
    length and is kept only if its whole group has no id (``keep_id`` is null
    then). Rows that repeat the kept id are all kept. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("points"), F.regexp_replace(text, ignored, "").alias("same"))
    # Length and id as one exact number: more points first, then the smaller id, then no id.
    big = F.lit(Decimal(2**66)).cast("decimal(38,0)")
    half = F.lit(Decimal(2**64)).cast("decimal(38,0)")
    rank = F.col("points").cast("decimal(20,0)") * big + F.when(F.col("doc_id").isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(half - F.col("doc_id").cast("decimal(20,0)"))
    ranked = rows.select(_hash128(F.col("same")).alias("h"), "same", rank.cast("decimal(38,0)").alias("rank"))
    groups = ranked.groupBy("h", "same").agg(F.count("*").alias("group_size"), F.max("rank").alias("best"))
    left = F.pmod(F.col("best"), big)
    keep = F.when(left == 0, F.lit(None).cast("long")).otherwise((half - left).cast("long"))
    # The second hash tells texts apart whose 128 bits collide, when rows look up their group.
    groups = groups.select(F.xxhash64("h").alias("k"), F.col("h").alias("gh"), F.sha2(F.col("same").cast("binary"), 256).alias("g256"), "group_size", keep.alias("keep_id"))
    out = rows.select("doc_id", F.xxhash64(_hash128(F.col("same"))).alias("k"), _hash128(F.col("same")).alias("h"), F.sha2(F.col("same").cast("binary"), 256).alias("text_sha256"))
    joined = out.join(groups, (out.k == groups.k) & (out.h == groups.gh) & (out.text_sha256 == groups.g256))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates of the whole ``documents`` table."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS same
  FROM documents)
SELECT doc_id,
       first(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY same) AS group_size,
       doc_id = first(doc_id) OVER w AS kept,
       sha256(same) AS text_sha256
FROM t WINDOW w AS (PARTITION BY same ORDER BY points DESC, doc_id)
"""
