"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the scoring workers.

Words are 64-bit hashes. Tasks count their bigrams in numpy and deal them into
buckets by context; a bucket merges its bigrams, writes them as one sorted hash
array with its counts, and passes on what each word adds up to (tokens, left
neighbours, and as a context its tokens and its continuations seen once, twice
and more). A second deal by word makes sorted word arrays. A context that is
frequent by a count sketch of all words is dealt by the whole bigram instead,
so no bucket holds one context's continuations alone.

The arrays are files in the shared folder, written under the bucket's name in
one move: a task run again writes the same file. Scoring looks a block's sorted
bigrams up in the mapped arrays; a worker reads only the pages it needs.

The order is 2: keeping each trigram once in the shuffle and once on disk takes
more than four times the input.
"""

from __future__ import annotations

import json
import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .quality import fold
from .storage import keyed_texts, new_path, table

U64 = np.uint64
END, START = U64(0x9B1C0DE50F7EA701), U64(0x57A70DE50F7EA703)
_K = U64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Ngrams:
    """bucket_bytes: input for each bucket, more where the buckets, each two mapped files, would be over most_buckets.
    gather: bigrams a task holds before it passes them on."""

    bucket_bytes: int = 4 << 20
    least_buckets: int = 48
    most_buckets: int = 1 << 14
    gather: int = 2 << 20
    sketch: int = 1 << 17
    block_bytes: int = 4 << 20


def tokens(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with each document's end, the token before each, and the documents' first tokens."""
    docs = len(at) - 1
    first = at[:-1] + np.arange(docs)
    out = np.empty(len(h) + docs, dtype=np.uint64)
    ends = at[1:] + np.arange(docs)
    word = np.ones(len(out), dtype=bool)
    word[ends] = False
    out[word], out[ends] = h, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first] = START
    return out, before, first


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return hashing.mix(before * _K + word)


def _bucket(before: np.ndarray, g: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """By the context, or by the whole bigram where the context's sketch slot is frequent."""
    key = np.where(hot[(before >> U64(7)) % U64(len(hot))], g, hashing.mix(before))
    return ((key >> U64(32)) % U64(n)).astype(np.int64)


def _sketch(p: Ngrams):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(p.sketch, dtype=np.int64)
        for batch in it:
            for _, _, h, at in hashing.batches(batch.column("text")):
                _, before, _ = tokens(h, at)
                counts += np.bincount(((before >> U64(7)) % U64(p.sketch)).astype(np.int64), minlength=p.sketch)
        # Slots of a task's common words only: what is rare everywhere is not frequent overall.
        some = np.flatnonzero(counts * 65536 > counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[counts[some], counts.sum()])], names=["slot", "n"])

    return run


def _pack(parts: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(a) for a in parts], dtype=np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in parts)])


def _unpack(b: bytes, types: tuple) -> list[np.ndarray]:
    sizes = np.frombuffer(b, dtype=np.int64, count=len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(b, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out


def _small(c: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, with those over 254 listed."""
    big = np.flatnonzero(c > 254)
    return [np.minimum(c, 255).astype(np.uint8), big.astype(np.uint32), c[big].astype(np.int64)]


def _large(small: np.ndarray, at: np.ndarray, big: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[at] = big
    return out


_BIGRAMS = (np.uint64, np.uint32, np.uint64, np.uint8, np.uint32, np.int64)
_WORDS = (np.uint64, *(np.uint8, np.uint32, np.int64) * 6)


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and each one's sums."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return [k[cut], *(np.add.reduceat(v[order], cut) if len(k) else v for v in values)]


def _count(p: Ngrams, hot: np.ndarray, n: int):
    def flush(before: list[np.ndarray], word: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        b, w = np.concatenate(before), np.concatenate(word)
        g = pair(b, w)
        order = np.argsort(g, kind="stable")
        g = g[order]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        c = np.diff(np.r_[cut, len(g)])
        b, w, g = b[order][cut], w[order][cut], g[cut]
        deal = _bucket(b, g, hot, n)
        order = np.lexsort((b, deal))
        b, w, c, deal = b[order], w[order], c[order], deal[order]
        cuts = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
        keys, blobs = [], []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(deal)], strict=True):
            x = b[lo:hi]
            runs = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            keys.append(int(deal[lo]))
            blobs.append(_pack([x[runs], np.diff(np.r_[runs, len(x)]).astype(np.uint32), w[lo:hi], *_small(c[lo:hi])]))
        for lo in range(0, len(keys), 64):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 64], pa.int32()), pa.array(blobs[lo : lo + 64], pa.binary())], names=["bucket", "data"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, word, held = [], [], 0
        for batch in it:
            for _, _, h, at in hashing.batches(batch.column("text")):
                w, b, _ = tokens(h, at)
                before.append(b)
                word.append(w)
                held += len(w)
                if held >= p.gather:
                    yield from flush(before, word)
                    before, word, held = [], [], 0
        if held:
            yield from flush(before, word)

    return run


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    os.makedirs(folder, exist_ok=True)
    temp = f"{folder}/.{name}.{os.getpid()}"
    with open(temp, "wb") as f:
        f.write(_pack(arrays))
    os.replace(temp, f"{folder}/{name}")


def _classes(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def _merge(folder: str, n: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        parts = [_unpack(x, _BIGRAMS) for x in t.column("data").to_pylist()]
        b = np.concatenate([np.repeat(x[0], x[1]) for x in parts])
        w = np.concatenate([x[2] for x in parts])
        c = np.concatenate([_large(*x[3:]) for x in parts])
        del parts
        g = pair(b, w)
        order = np.argsort(g, kind="stable")
        g = g[order]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        c = np.add.reduceat(c[order], cut)
        b, w, g = b[order][cut], w[order][cut], g[cut]
        _save(folder, f"pairs-{key[0].as_py()}", [g, *_small(c)])
        ctx, total, n1, n2, n3 = _summed(b, c, *((c == k).astype(np.int64) for k in (1, 2)), (c > 2).astype(np.int64))
        word, count, cont = _summed(w, c, np.ones(len(w), dtype=np.int64))
        zero, none = np.zeros(len(ctx), np.int64), np.zeros(len(word), np.int64)
        h = np.concatenate([ctx, word])
        values = [np.concatenate(x) for x in ((zero, count), (zero, cont), (total, none), (n1, none), (n2, none), (n3, none))]
        h, *values = _summed(h, *values)
        deal = ((hashing.mix(h) >> U64(16)) % U64(n)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        cuts = np.searchsorted(deal[order], np.arange(n + 1))
        keys, blobs = [-1], [json.dumps(_classes(c)).encode()]
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[k] : cuts[k + 1]]
            keys.append(k)
            blobs.append(_pack([h[rows], *(a for v in values for a in _small(v[rows]))]))
        return pa.table({"bucket": pa.array(keys, pa.int32()), "data": pa.array(blobs, pa.binary())})

    return run


def _words(folder: str):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        blobs = t.column("data").to_pylist()
        stats = dict.fromkeys(_STATS, 0)
        if k < 0:
            stats |= zip(_STATS[:4], np.sum([json.loads(x) for x in blobs], axis=0).tolist(), strict=True)
        else:
            parts = [_unpack(x, _WORDS) for x in blobs]
            h, *v = _summed(np.concatenate([x[0] for x in parts]), *(np.concatenate([_large(*x[i : i + 3]) for x in parts]) for i in range(1, 19, 3)))
            _save(folder, f"words-{k}", [h, *(a for x in v for a in _small(x))])
            stats |= zip(_STATS[4:], (*_classes(v[1]), int(v[0].sum()), int((v[0] > 0).sum()), int(v[1].sum()), int((v[1] > 2).sum())), strict=True)
        return pa.table({c: pa.array([n], pa.int64()) for c, n in stats.items()})

    return run


#: Pairs and words by count 1 to 4, tokens, types, distinct pairs, words with more than two left neighbours.
_STATS = (*(f"pairs_{k}" for k in range(1, 5)), *(f"conts_{k}" for k in range(1, 5)), "tokens", "types", "links", "more")


def _discounts(n: list[int]) -> list[float]:
    """The three discounts from the counts of counts; where those are too few for an estimate, none exceeds its count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the files of ``folder``; a few numbers, whatever the input."""

    folder: str
    buckets: int
    hot: np.ndarray
    tokens: int
    types: int
    pair_discounts: tuple
    word_discounts: tuple
    links: int
    floor: float


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"workers map the model's files: spark.checkpoint.dir must be a file system all executors mount, not {path}")
    return path


def fit(docs: DataFrame, p: Ngrams = Ngrams()) -> Model:
    """Counts ``text`` of all ``docs``; a null or empty text is its end alone."""
    spark = docs.sparkSession
    folder = _local(new_path(spark, "ngrams"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(p.least_buckets, min(p.most_buckets, size // p.bucket_bytes))
    texts = docs.select("text")
    slots = {r["slot"]: r["n"] for r in texts.mapInArrow(_sketch(p), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # at most p.sketch rows
    whole = slots.pop(-1, 0)
    hot = np.zeros(p.sketch, dtype=bool)
    hot[[s for s, c in slots.items() if c * 8 * n > whole]] = True
    pairs = texts.mapInArrow(_count(p, hot, n), "bucket int, data binary")
    words = pairs.groupBy("bucket").applyInArrow(_merge(folder, n), "bucket int, data binary")
    sums = words.groupBy("bucket").applyInArrow(_words(folder), ", ".join(f"{c} long" for c in _STATS)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STATS)).first()
    pair_counts, conts = ([sums[f"{t}_{k}"] for k in range(1, 5)] for t in ("pairs", "conts"))
    d = _discounts(conts)
    spare = (d[0] * conts[0] + d[1] * conts[1] + d[2] * sums["more"]) / sums["links"] if sums["links"] else 1.0
    return Model(folder, n, hot, sums["tokens"], sums["types"], tuple(_discounts(pair_counts)), tuple(d), sums["links"], spare / (sums["types"] + 1))


class _Mapped:
    """Arrays of one file, mapped."""

    def __init__(self, path: str, types: tuple):
        try:
            with open(path, "rb") as f:
                self.arrays = _unpack(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), types)
        except FileNotFoundError:  # a bucket that got no rows has no file
            self.arrays = [np.zeros(0, t) for t in types]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of sorted hashes, and which of them are there."""
        keys = self.arrays[0]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def values(self, column: int, at: np.ndarray) -> np.ndarray:
        small, where, big = self.arrays[1 + 3 * column : 4 + 3 * column]
        out = small[at].astype(np.int64)
        over = np.flatnonzero(out == 255)
        if len(over):
            out[over] = big[np.searchsorted(where, at[over])]
        return out


def _lookup(h: np.ndarray, deal: np.ndarray, files: str, types: tuple, columns: int, opened: dict) -> np.ndarray:
    """Values of each hash by its bucket's file, 0 where it is not."""
    out = np.zeros((columns, len(h)), dtype=np.int64)
    order = np.lexsort((h, deal))
    sorted_deal = deal[order]
    cuts = np.flatnonzero(np.r_[True, sorted_deal[1:] != sorted_deal[:-1]]) if len(h) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(h)], strict=True):
        k = int(sorted_deal[lo])
        if (files, k) not in opened:
            if len(opened) >= 2 * 16_384:  # what one process may map is bounded
                opened.clear()
            opened[files, k] = _Mapped(f"{files}-{k}", types)
        m, rows = opened[files, k], order[lo:hi]
        at, there = m.find(h[rows])
        for c in range(columns):
            out[c, rows[there]] = m.values(c, at[there])
    return out


def _score(model: Model, p: Ngrams):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        d, e = np.array([0, *model.pair_discounts]), np.array([0, *model.word_discounts])
        for batch in it:
            data, offsets = hashing.utf8(batch.column("text"))
            for lo, hi in hashing.blocks(offsets, p.block_bytes):
                hs, ats, base = [], [np.zeros(1, np.int64)], 0
                for a, b in hashing.blocks(offsets[lo : hi + 1]):
                    part = offsets[lo + a : lo + b + 1]
                    h, at, _, _ = hashing.words(data[part[0] : part[-1]], part - part[0])
                    hs.append(h)
                    ats.append(at[1:] + base)
                    base += len(h)
                word, before, first = tokens(np.concatenate(hs), np.concatenate(ats))
                types, back = np.unique(np.concatenate([word, [START]]), return_inverse=True)
                deal = ((hashing.mix(types) >> U64(16)) % U64(model.buckets)).astype(np.int64)
                known = _lookup(types, deal, f"{model.folder}/words", _WORDS, 6, opened)
                w = back[:-1]
                v = np.empty_like(w)
                v[1:] = w[:-1]
                v[first] = back[-1]
                g = pair(before, word)
                (c,) = _lookup(g, _bucket(before, g, model.hot, model.buckets), f"{model.folder}/pairs", _BIGRAMS[2:], 1, opened)
                count, cont, total, n1, n2, n3 = known
                lower = np.maximum(cont - e[np.minimum(cont, 3)], 0) / max(1, model.links) + model.floor
                gamma = (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1)
                gamma[total == 0] = 1.0
                prob = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[v], 1) + gamma[v] * lower[w]
                plain = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))[w]
                sums = [np.add.reduceat(x, first) for x in (np.log10(prob), plain, (count > 0)[w].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(lo, hi - lo) for k in ("doc_id", "held_out")),
                        pa.array(np.diff(np.r_[first, len(word)])),
                        pa.array(sums[2]),
                        pa.array(np.full(hi - lo, model.tokens, dtype=np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[0]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model, p: Ngrams = Ngrams()) -> DataFrame:
    """``docs`` (``doc_id, held_out, text``) with their token counts and log10 probabilities."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(model, p), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, p: Ngrams = Ngrams()) -> DataFrame:
    """Learns from the documents whose id's fold of 5 is not 1 and scores all.

    Repeated rows and null ids count and are scored each; a null or empty text
    is its end alone; an empty table gives an empty result, and with nothing to
    learn from every token has the same chance; other columns are ignored.
    """
    docs = keyed_texts(docs).withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
    return score(docs, fit(docs.where(~F.col("held_out")), p), p)


def op8_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Perplexity scores of the whole ``documents`` table."""
    return score_held_out(table(spark, sf_dir, "documents"))
