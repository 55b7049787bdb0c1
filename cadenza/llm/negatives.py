"""Hard negatives by distributed radix selection.

Anchors and rows are dealt into blocks by a hash of their row, and every block
of anchors meets every block of rows once a pass. A pass multiplies the two
blocks of integer vectors and counts the scores that fall into each window (an
anchor's own label, or the band below one of its positives) by one digit, the
highest first. Spark adds the histograms up and finds the digit that holds the
k-th score; the next pass counts the next digit inside it. After the last one
the k-th score is known to the unit, and a last pass gathers only the rows
above it and those ties that can still be among the first.

A block counts from the top and leaves out what stands below its own k-th
score, which cannot be above the k-th of all, and gathers of the ties at the
k-th score as many of the smallest ids as are still wanted, so what a pass
passes on is bounded for a window and a block, however many rows tie. Scores
are computed anew in each pass; no table of pairs is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import dropped, spread, table, written

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Mining:
    """positives, negatives: how many of each are wanted. low, high: the window of a negative's score in percent of the
    positive's. scale: a component x counts as floor(scale * x). block: anchors and rows of a block. digit: bits counted in a pass."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    block: int = 1024
    digit: int = 10


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    at = np.asarray(lists.offsets)
    size = np.diff(at)
    out = np.zeros((len(size), width), dtype=kind)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)] = np.asarray(lists.values)[at[0] : at[-1]]
    return out


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and each element's place in its run."""
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return start, np.arange(len(sorted_keys)) - np.repeat(start, np.diff(np.r_[start, len(sorted_keys)]))


def _meet(same: bool, width: int, kind: type, base: int, shift: int | None):
    """Histograms of a block of windows over a block of rows by the digits above ``shift``, or with None the rows that qualify."""

    def hits(wins: pa.Table, rows: pa.Table):
        """Window and row numbers of all scores inside windows, and the scores."""
        q, first, back = np.unique(wins.column("q").to_numpy(), return_index=True, return_inverse=True)
        scores = (_matrix(wins.column("v").take(pa.array(first)), width, kind) @ _matrix(rows.column("v"), width, kind).T).astype(np.int64)
        label = wins.column("label").to_numpy()[first]
        allowed = label[:, None] == rows.column("label").to_numpy()[None, :]
        allowed = allowed & (q[:, None] != rows.column("row").to_numpy()[None, :]) if same else ~allowed
        lo, hi = wins.column("lo").to_numpy(), wins.column("hi").to_numpy()
        order = np.argsort(back, kind="stable")
        _, slot = _runs(back[order])
        # Windows of an anchor one after the other: no more than one matrix at a time.
        for k in range(int(slot.max()) + 1 if len(slot) else 0):
            w = order[slot == k]
            s = scores[back[w]]
            i, j = np.nonzero(allowed[back[w]] & (s >= lo[w, None]) & (s <= hi[w, None]))
            yield w[i], j, s[i, j]

    def count(wins: pa.Table, rows: pa.Table) -> pa.Table:
        low, high, need = (wins.column(c).to_numpy() for c in ("cut_lo", "cut_hi", "need"))
        parts = []
        for w, _, s in hits(wins, rows):
            inside = (s >= low[w]) & (s <= high[w])
            w, d = w[inside], (s[inside] - base) >> shift
            order = np.lexsort((-d, w))
            w, d = w[order], d[order]
            start = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (d[1:] != d[:-1])]) if len(w) else np.zeros(0, np.int64)
            _, above = _runs(w)
            keep = above[start] < need[w[start]]
            n = np.diff(np.r_[start, len(w)])
            parts.append((w[start][keep], d[start][keep], n[keep]))
        w, d, n = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
        some = wins.take(pa.array(w)).select(["q", "w", "need"])
        return some.append_column("d", pa.array(d, pa.int64())).append_column("n", pa.array(n, pa.int64()))

    def gather(wins: pa.Table, rows: pa.Table) -> pa.Table:
        low, high, need = (wins.column(c).to_numpy() for c in ("cut_lo", "cut_hi", "need"))
        ids = rows.column("vec_id")
        none, known, number = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy(), rows.column("row").to_numpy()
        parts = []
        for w, j, s in hits(wins, rows):
            sure = s > high[w]
            tied = np.flatnonzero(~sure & (s >= low[w]))
            tied = tied[np.lexsort((number[j[tied]], known[j[tied]], none[j[tied]], w[tied]))]
            _, place = _runs(w[tied])
            at = np.r_[np.flatnonzero(sure), tied[place < need[w[tied]]]]
            parts.append((w[at], j[at], s[at]))
        w, j, s = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
        some, found = wins.take(pa.array(w)).select(["q", "w"]), rows.take(pa.array(j))
        for name in ("row", "vec_id"):
            some = some.append_column(name, found.column(name))
        return some.append_column("score", pa.array(s, pa.int64()))

    return gather if shift is None else count


def _select(spark: SparkSession, rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, blocks: tuple[int, int], width: int, bound: int, p: Mining) -> DataFrame:
    """Of each window (``q, w, lo, hi, need``) its first ``need`` rows by score, then id: ``q, w, row, vec_id, score, rank``."""
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    a, r = blocks
    left = rows.select(F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("a"), F.pmod(F.xxhash64("row"), F.lit(r)).cast("int").alias("r"), *(F.col(c).alias(c) for c in ("row", "vec_id", "label", "v")))

    def meet(windows: DataFrame, shift: int | None, schema: str) -> DataFrame:
        wins = windows.join(anchors, "q").select(F.pmod(F.xxhash64("q"), F.lit(a)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"), "q", "w", "lo", "hi", "cut_lo", "cut_hi", "need", "label", "v")
        return wins.groupBy("a", "r").cogroup(left.groupBy("a", "r")).applyInArrow(_meet(same, width, kind, -bound, shift), schema)

    state = written(windows.withColumns({"cut_lo": F.lit(-bound), "cut_hi": F.lit(bound)}), "windows")
    bits = (2 * bound).bit_length()
    for shift in range((bits - 1) // p.digit * p.digit, -1, -p.digit):
        sums = meet(state, shift, "q long, w int, need long, d long, n long").groupBy("q", "w", "d").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
        upto = F.sum("n").over(Window.partitionBy("q", "w").orderBy(F.col("d").desc()))
        found = sums.withColumn("upto", upto).where("upto >= need AND upto - n < need").select("q", "w", "d", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
        least = F.lit(-bound) + F.shiftleft(F.col("d"), shift)
        # A window with no such digit has too few rows: all of them are above its cut, and it is counted no more.
        after = state.join(found, ["q", "w"], "left").select("q", "w", "lo", "hi", F.coalesce(least, F.lit(-bound - 1)).alias("cut_lo"), F.coalesce(least + ((1 << shift) - 1), F.lit(-bound - 1)).alias("cut_hi"), F.coalesce("left", F.lit(0)).alias("need"))
        after = written(after, "windows")
        dropped(state)
        state = after
    got = meet(state, None, "q long, w int, row long, vec_id long, score long")
    most = p.positives if same else p.negatives
    rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    out = written(got.withColumn("rank", rank).where(F.col("rank") <= most), "selected")
    dropped(state)
    return out


def mine(vectors: DataFrame, anchor: Column, p: Mining = Mining()) -> DataFrame:
    """Hard negatives of the anchors of ``vectors`` (``vec_id`` long, ``label``, ``embedding`` of numbers); ``anchor``: a condition on them.

    Scores are inner products of components turned into whole numbers; higher
    ones come first, ties by the smaller id, then rows without an id, then as
    numbered on reading. An anchor's positives are its first other rows of its
    label; a positive's negatives are the first rows of other labels whose
    score lies in the window. Returns ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``.

    Rows without a label or a vector, or with a component that is null or not
    finite, take no part. A row that repeats another's id is a row of its own
    and may be the other's positive. A shorter vector counts as one that ends
    in zeros. Scores that could exceed 2**55 are an error. Without anchors,
    positives or rows in a window the result has no rows for them; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    whole = F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")) & ~F.isnan(e.cast("double")))
    rows = spread(vectors).where(F.col("label").isNotNull() & x.isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(p.scale)))).alias("v"),
    )
    rows = written(rows, "vectors")
    top = F.max(F.array_max(F.transform("v", lambda e: F.abs(e.cast("double")))))
    told = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("width"), top.alias("top")).first()
    if not told["anchors"]:
        return spark.createDataFrame([], RESULT)
    width, most = told["width"], int(told["top"] or 0) + 1
    bound = max(1, width * most * most)
    if bound >= 1 << 55:
        raise ValueError(f"scores of {width} components of up to {most} could exceed 2**55")
    blocks = tuple(-(-told[c] // p.block) for c in ("anchors", "n"))
    anchors = rows.where("anchor").select(F.col("row").alias("q"), F.col("vec_id").alias("anchor_id"), "label", "v")
    own = anchors.select("q", F.lit(1).alias("w"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"), F.lit(p.positives).cast("long").alias("need"))
    positives = _select(spark, rows, anchors, own, True, blocks, width, bound, p)
    hundredth = lambda c: (c - F.pmod(c, F.lit(100))) / 100
    s = F.col("score")
    lo, hi = -F.expr(f"(-{p.low} * score - pmod(-{p.low} * score, 100)) div 100"), F.expr(f"({p.high} * score - pmod({p.high} * score, 100)) div 100")
    below = positives.select("q", F.col("rank").alias("w"), lo.alias("lo"), hi.alias("hi"), F.lit(p.negatives).cast("long").alias("need")).where("lo <= hi")
    negatives = _select(spark, rows, anchors, below, False, blocks, width, bound, p)
    named = positives.select("q", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), s.alias("positive_score")).join(anchors.select("q", "anchor_id"), "q")
    found = negatives.select("q", "w", "rank", F.col("vec_id").alias("negative_id"), s.alias("negative_score"))
    return found.join(named, ["q", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector of ``embeddings`` over the whole table, every seventh one's label moved on by one."""
    k, label = F.col("vec_id"), F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(k % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return mine(rows, k % 50 == 0)


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
