"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Random indexing over all texts: every word and every word shape (the kinds
   of its first and last characters) owns a sparse random index vector. The
   context vector of a word or shape is the sum of its neighbours' index
   vectors within ``window`` words. Words share ``word_rows`` rows by their
   hash, so the table's size is fixed and a task adds up its part in numpy.
2. A document is the mean, the spread and the mean step from word to word of
   its word and shape vectors, with its length.
3. A network of one hidden layer, trained in numpy on at most ``sample``
   labelled rows (a documented bound); ``calibration`` of them are set aside to
   fit the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .storage import keyed_texts, numbered_columns, spread, table

U64 = np.uint64


@dataclass(frozen=True)
class Quality:
    dims: int = 24
    word_rows: int = 1 << 13
    shape_rows: int = 1 << 10
    window: int = 2
    marks: int = 2
    hidden: int = 32
    sample: int = 20_000
    calibration: float = 0.2
    epochs: int = 60
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 9

    @property
    def rows(self) -> int:
        return self.word_rows + self.shape_rows

    @property
    def features(self) -> int:
        return 6 * self.dims + 3


#: Kinds of bytes that make a word's shape: lower, upper, digit, beyond ASCII; marks stand for themselves.
_KIND = np.arange(256, dtype=np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def units(data: np.ndarray, offsets: np.ndarray, p: Quality) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, shape rows, word hashes, shape hashes and documents' offsets of a block."""
    h, at, start, end = hashing.words(data, offsets)
    last = end - 1
    shape = ((_KIND[data[start]] * U64(256) + _KIND[data[np.minimum(start + 1, last)]]) * U64(256) + _KIND[data[np.maximum(last - 1, start)]]) * U64(256) + _KIND[data[last]]
    s = hashing.mix(shape + U64(1 << 40))
    return (h % U64(p.word_rows)).astype(np.int64), (s % U64(p.shape_rows)).astype(np.int64) + p.word_rows, h, s, at


def _add(sums: np.ndarray, rows: np.ndarray, other: np.ndarray, p: Quality) -> None:
    """Adds the index vectors of ``other`` hashes to the context vectors of ``rows``."""
    for k in range(p.marks):
        x = hashing.mix(other + U64(0x1234567 * (k + 1)))
        where = rows * p.dims + ((x >> U64(8)) % U64(p.dims)).astype(np.int64)
        sums += np.bincount(where, weights=np.where(x & U64(1), 1.0, -1.0), minlength=len(sums))


def _contexts(p: Quality):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(p.rows * p.dims), np.zeros(p.rows)
        for batch in it:
            data, offsets = hashing.utf8(batch.column("text"))
            for lo, hi in hashing.blocks(offsets):
                part = offsets[lo : hi + 1]
                w, s, h, sh, at = units(data[part[0] : part[-1]], part - part[0], p)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                counts += np.bincount(w, minlength=p.rows) + np.bincount(s, minlength=p.rows)
                for o in range(1, p.window + 1):
                    a, b = np.arange(max(0, len(h) - o)), np.arange(o, max(o, len(h)))
                    ok = doc[a] == doc[b]
                    a, b = a[ok], b[ok]
                    _add(sums, np.concatenate([w[a], w[b], s[a], s[b]]), np.concatenate([h[b], h[a], sh[b], sh[a]]), p)
        kept = np.flatnonzero(counts)
        v = sums.reshape(p.rows, p.dims)[kept].astype(np.int64)
        for lo in range(0, len(kept), 4096):
            some = slice(lo, lo + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(kept[some]), pa.array(counts[kept[some]].astype(np.int64)), *(pa.array(v[some, d]) for d in range(p.dims))], names=["row", "n", *(f"d{d}" for d in range(p.dims))])

    return run


def word_vectors(docs: DataFrame, p: Quality) -> np.ndarray:
    """The table of context vectors, scaled to unit length: ``rows`` by ``dims``, whatever the size of the input."""
    names = [f"d{d}" for d in range(p.dims)]
    parts = docs.select("text").mapInArrow(_contexts(p), "row long, n long, " + ", ".join(f"{c} long" for c in names))
    summed = parts.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
    out = np.zeros((p.rows, p.dims), dtype=np.float32)
    got = summed.toPandas()  # at most p.rows rows
    if len(got):
        v = got[names].to_numpy(dtype=np.float64)
        out[got["row"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, p: Quality) -> np.ndarray:
    """Features of each document of a block; without words all are 0."""
    w, s, _, _, at = units(data, offsets, p)
    n = len(at) - 1
    out = np.zeros((n, p.features), dtype=np.float32)
    size = np.diff(at)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    first, count = at[some], size[some][:, None].astype(np.float32)
    for k, rows in enumerate((w, s)):
        v = vectors[rows]
        mean = np.add.reduceat(v, first, axis=0) / count
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first, axis=0) / count - mean * mean, 0))
        step = np.zeros_like(v)
        np.abs(v[1:] - v[:-1], out=step[1:])
        step[first] = 0
        steps = np.add.reduceat(step, first, axis=0) / np.maximum(count - 1, 1)
        out[some, 3 * k * p.dims : 3 * (k + 1) * p.dims] = np.hstack([mean, spread, steps])
    same = np.zeros(len(w), dtype=np.float32)
    same[1:] = w[1:] == w[:-1]
    same[first] = 0
    out[some, -3] = np.add.reduceat(same, first) / count[:, 0]
    out[some, -2] = np.log1p(count[:, 0])
    out[some, -1] = np.log1p(np.diff(offsets)[some] / count[:, 0])
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, p: Quality) -> Network:
    """Adam on the cross-entropy, then the temperature that suits the rows set aside. With one label only, a constant."""
    rng = np.random.default_rng(p.seed)
    d = p.features
    if not len(y) or y.min() == y.max():
        sure = 0.5 if not len(y) else float(y[0])
        return Network(np.zeros(d), np.ones(d), np.zeros((d, p.hidden)), np.zeros(p.hidden), np.zeros(p.hidden), (sure - 0.5) * 8, 1.0)
    order = rng.permutation(len(y))
    aside = order[: int(len(y) * p.calibration)]
    fit = order[len(aside) :]
    mean, scale = x[fit].mean(0, dtype=np.float64), x[fit].std(0, dtype=np.float64) + 1e-3
    z, t = (x[fit] - mean) / scale, y[fit].astype(np.float64)
    theta = [rng.normal(0, d**-0.5, (d, p.hidden)), np.zeros(p.hidden), rng.normal(0, p.hidden**-0.5, p.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta], 0
    for _ in range(p.epochs):
        shuffled = rng.permutation(len(t))
        for lo in range(0, len(t), 256):
            rows = shuffled[lo : lo + 256]
            a = np.tanh(z[rows] @ theta[0] + theta[1])
            e = (1 / (1 + np.exp(-np.clip(a @ theta[2] + theta[3], -40, 40))) - t[rows]) / len(rows)
            back = np.outer(e, theta[2]) * (1 - a * a)
            grads = [z[rows].T @ back + p.decay * theta[0], back.sum(0), a.T @ e + p.decay * theta[2], e.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                theta[k] -= p.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), 1.0)
    if len(aside):
        logits, truth = net.logits(x[aside].astype(np.float64)), y[aside]
        loss = lambda c: np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / c).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _features(vectors, p: Quality):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vectors.value
        for batch in it:
            data, offsets = hashing.utf8(batch.column("text"))
            for lo, hi in hashing.blocks(offsets):
                part = offsets[lo : hi + 1]
                x = pooled(data[part[0] : part[-1]], part - part[0], v, p)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return run


def _score(model, p: Quality, keep: list[str], text: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = model.value
        for batch in it:
            data, offsets = hashing.utf8(batch.column(text))
            for lo, hi in hashing.blocks(offsets):
                part = offsets[lo : hi + 1]
                score = net.score(pooled(data[part[0] : part[-1]], part - part[0], v, p))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(score, pa.float64())], names=[*keep, "score"])

    return run


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def fitted(docs: DataFrame, labels: DataFrame, p: Quality = Quality()):
    """Word vectors of ``docs`` and a network trained on ``labels`` (``doc_id, quality``), broadcast.

    Rows of ``labels`` whose id's fold of 3 is 1, without a quality, or without
    a document are not learnt from. Of the others, the ``sample`` rows that
    come first by a hash of their id are. Of documents that repeat such an id
    the one with the least features counts, so no more rows than that are gathered.
    """
    spark = docs.sparkSession
    docs = spread(docs)
    vectors = word_vectors(docs, p)
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where((fold(F.col("doc_id"), 3) != 1) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    # Only labels of documents that are there count towards the bound.
    use = use.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(p.sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(use.select("doc_id").distinct()), "doc_id", "left_semi")
    held = spark.sparkContext.broadcast(vectors)
    x = rows.mapInArrow(_features(held, p), "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(use), "doc_id").toPandas()
    x = x.assign(x=x["x"].map(bytes)).sort_values(["doc_id", "quality", "x"], ignore_index=True)
    feats = np.frombuffer(b"".join(x["x"]), dtype=np.float32).reshape(len(x), p.features)
    net = train(feats, x["quality"].to_numpy(), p)
    return spark.sparkContext.broadcast((vectors, net))


def scored(docs: DataFrame, model, p: Quality = Quality(), name: str = "score") -> DataFrame:
    """``docs`` with the model's score as ``name``; a column of that name is replaced. A null or empty text has a score too."""
    names = [c for c in docs.columns if c.lower() != name.lower()]
    rows = numbered_columns(spread(docs).select(*("`" + c.replace("`", "``") + "`" for c in names)))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", score double"
    return rows.mapInArrow(_score(model, p, rows.columns, names.index("text")), schema).toDF(*names, name)


def classify(docs: DataFrame, labels: DataFrame, p: Quality = Quality()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of whole texts.

    Repeated rows and null ids give a row each; an empty ``docs`` gives an
    empty result; without labels every score is 0.5; other columns are ignored.
    """
    docs = keyed_texts(docs)
    out = scored(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), fitted(docs, labels, p), p)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of the whole ``documents`` table, learnt from ``labels``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
