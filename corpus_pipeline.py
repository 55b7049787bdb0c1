"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``, in order, whatever they are called: names
that a stage uses for itself give way, and other columns pass as they are.

In every stage a null text counts as empty, a row stands for itself even if its
id is null or repeated, equal rows are rows of their own until ``exact`` takes
them together, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.exact_dedup import IGNORED, exact_duplicates
from cadenza.llm.near_dedup import NearDedup, near_duplicates
from cadenza.llm.packing import pack
from cadenza.llm.quality import fitted, scored
from cadenza.llm.secrets import redact
from cadenza.llm.storage import new_path, table, written

#: SQL cannot express training, near duplicates or tokenizing: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def _all(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier takes for good (a score of 0.5 or more) go on.

    A null or empty text has a score like any other, so all of them go or stay
    together, as do all rows of one text. Without labels every score is 0.5 and
    all go on.
    """
    name = _free(docs, "score")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")), name=name).where(F.col(name) >= 0.5).select(*_all(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row goes on: of the longest original, then the smallest id, rows without an id last.

    Null and empty texts, and those of white space only, are one group. Of rows
    that repeat the id and the length, the one whose text comes first goes on,
    then the one whose columns, as JSON, do.
    """
    decided = written(exact_duplicates(docs).select("doc_id", "text_sha256", "kept"), "exact")
    same = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), IGNORED, "")
    sha, key, of, number = (_free(docs, n) for n in ("text_sha256", "key_id", "key_sha256", "key_row"))
    rows = docs.withColumn(sha, F.sha2(same.cast("binary"), 256))

    def meet(keys: DataFrame, how: str, to: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(of))
        return to.join(keys.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(of)), how)

    left = meet(decided.where("NOT kept"), "left_anti", rows)
    # Rows that repeat the kept id: one of them is left, by what they hold.
    again = decided.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not again.isEmpty():
        left = written(left.withColumn(number, F.monotonically_increasing_id()), "repeated")
        whole = F.to_json(F.struct(*_all(docs)))
        first = F.min(F.struct((-F.length("text")).alias("points"), F.col("text").alias("text"), whole.alias("whole"), F.col(number).alias("number")))
        one = meet(again, "left_semi", left).groupBy("doc_id", sha).agg(first.alias("first")).select(F.col("first.number").alias(of))
        left = meet(again, "left_anti", left).unionByName(meet(again, "left_semi", left).join(one.hint("shuffle_hash"), F.col(number) == F.col(of), "left_semi"))
    return left.select(*_all(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that link at a shingle similarity of 0.8 or more the smallest id goes on.

    Texts without words link with nothing and all go on. Where ids repeat or
    are missing, rows are numbered by id (missing ones last) and text, and the
    first of a group goes on.
    """
    many = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    key = "doc_id"
    if not many.isEmpty():
        key = _free(docs, "row_number")
        # Sorted partitions number their rows one after the other; written, the numbers stay.
        docs = written(docs.sort(F.col("doc_id").asc_nulls_last(), "text").withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"), NearDedup(percent=80))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(key))
    kept = docs.join(gone.hint("shuffle_hash"), key, "left_anti")
    return kept.select(*(c for c, n in zip(_all(docs), docs.columns, strict=True) if n != key or key == "doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that holds a secret, plain or encoded, gives way to a mark; ``n_chars`` follows. Null texts stay null."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*_all(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens; a null or empty text is its end id alone."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
