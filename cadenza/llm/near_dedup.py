"""Near-duplicate detection: MinHash bands and sequential Bayesian verification.

1. Each document becomes the set of its hashed word shingles. Documents with
   the same set are one class, kept under its smallest id, so exact copies of
   any number cost one row.
2. Bands of ``rows`` MinHash values make buckets. A pair is a candidate if it
   has a bucket in common, whatever the size of that bucket.
3. Every member of a bucket is compared with the smallest member of the buckets
   it has, that one which it meets in most. Groups of near copies so come
   together at a cost of one comparison a member.
4. Of what is left, pairs of a bucket whose members are not connected yet, each
   pair is compared in the first bucket it has in common. First signatures only
   are dealt; then the whole sets of those documents that a signature could not
   tell apart.
5. Signatures are compared ``step`` values at a time; a pair goes as soon as the
   posterior probability that its similarity reaches the threshold is under
   ``miss``. Survivors are verified on their full shingle sets, the most similar
   first, and pairs already connected are skipped: a task returns a spanning
   forest, never all pairs.
6. Components of the verified links give the result.

Members of a bucket are dealt to blocks by a hash, as many as keep a block to
about ``block`` documents and ``block_bytes`` of sets, and every pair of blocks
meets once: no task holds more than two blocks, and no key is one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .graph import SALTS, components
from .storage import keyed_texts, table, written

U64 = np.uint64
_Q = U64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class NearDedup:
    """``percent``: a pair links when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 5
    step: int = 16
    miss: float = 1e-6
    block: int = 512
    block_bytes: int = 8 << 20
    seed: int = 20240229

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingles(h: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block; fewer words than ``width`` make one shingle."""
    full = np.zeros(0, np.uint64)
    if len(h) >= width:
        full = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            full = full * _Q + h[k : len(h) - width + 1 + k]
        full = hashing.mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            x = U64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = x * _Q + w
            out.append(hashing.mix(np.array([x], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, flip: np.ndarray, odd: np.ndarray) -> np.ndarray:
    top = (s >> U64(32)).astype(np.uint32)
    out = np.full(len(odd), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(top), 2048):
        np.minimum(out, ((top[k : k + 2048, None] ^ flip) * odd).min(0), out=out)
    return out


def _family(p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(p.seed))
    return rng.integers(0, 1 << 32, p.hashes, dtype=np.uint32), rng.integers(0, 1 << 31, p.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bounds(p: NearDedup) -> list[tuple[int, int]]:
    """After n values, the fewest matches a pair needs to stay.

    With a uniform prior, P(similarity >= t | m of n match) is the chance that
    a binomial of n + 1 trials with probability t is at most m.
    """
    t, out = p.percent / 100, []
    for n in [*range(p.step, p.hashes, p.step), p.hashes]:
        tail, m = 0.0, -1
        while tail < p.miss and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _keys(sig: np.ndarray, p: NearDedup) -> np.ndarray:
    """Bucket of each band of each signature."""
    x = sig.astype(np.uint64).reshape(len(sig), p.bands, p.rows)
    k = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), (len(sig), p.bands))
    for c in range(p.rows):
        k = hashing.mix(k * _Q + x[:, :, c])
    return k.view(np.int64)


def _sketch(p: NearDedup):
    flip, odd = _family(p)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column("doc_id")
            for lo, hi, h, at in hashing.batches(batch.column("text")):
                sets = shingles(h, at, p.words)
                some = [s for s in sets if len(s)]
                keys = _keys(np.array([signature(s, flip, odd) for s in some], dtype=np.uint32).reshape(len(some), p.hashes), p)
                ends = np.cumsum([0, *(p.bands if len(s) else 0 for s in sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _resketch(p: NearDedup, whole: bool):
    flip, odd = _family(p)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, h, at in hashing.batches(batch.column("text")):
                sets = shingles(h, at, p.words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "meets")),
                        pa.array([signature(s, flip, odd).tobytes() for s in sets], pa.binary()),
                        pa.array([s.tobytes() if whole else b"" for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "meets", "signature", "shingles"],
                )

    return run


def _survivors(sig: np.ndarray, side: np.ndarray, group: np.ndarray, bucket: int | None, p: NearDedup, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that signatures cannot tell apart and their matches: of different groups, of sides 0 and 1 if there is a side 1, and with ``bucket`` as their first in common."""
    n = len(sig)
    cross = bool(side.any())
    keys = _keys(sig, p) if bucket is not None else None
    out: list[list[np.ndarray]] = [[], [], []]
    width = max(1, (1 << 21) // max(1, n * p.step))
    for lo in range(0, n, width):
        rows = np.arange(lo, min(n, lo + width))
        ok = side[rows][:, None] < side[None, :] if cross else rows[:, None] < np.arange(n)[None, :]
        i, j = np.nonzero(ok & (group[rows][:, None] != group[None, :]))
        i += lo
        m, done = np.zeros(len(i), np.int32), 0
        for upto, need in limits:
            if not len(i):
                break
            m = m + (sig[i, done:upto] == sig[j, done:upto]).sum(1, dtype=np.int32)
            keep = m >= need
            i, j, m, done = i[keep], j[keep], m[keep], upto
        if keys is not None and len(i):
            first = (keys[i] == keys[j]).argmax(1)
            keep = (keys[i, first] == bucket) & (keys[j, first] == bucket)
            i, j, m = i[keep], j[keep], m[keep]
        for a, x in zip(out, (i, j, m), strict=True):
            a.append(x)
    return tuple(np.concatenate(x) for x in out)


def _links(ids: np.ndarray, i: np.ndarray, j: np.ndarray, m: np.ndarray, sets: list[bytes], p: NearDedup) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that link."""
    n = len(ids)
    order = np.argsort(-m, kind="stable")
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    full: dict[int, np.ndarray] = {}
    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        for k in (a, b):
            if k not in full:
                full[k] = np.frombuffer(sets[k], dtype=np.uint64)
        x, y = full[a], full[b]
        if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
            continue
        both = np.intersect1d(x, y, assume_unique=True).size
        if 100 * both >= p.percent * (len(x) + len(y) - both):
            parent[ra] = rb
            out.append((int(ids[a]), int(ids[b])))
    return out


_TASK = ("place", "lo", "hi")
_TASK_TYPE = "place: bigint, lo: int, hi: int, side: int, grp: bigint"


def _meeting(p: NearDedup, verify: bool, buckets: bool):
    """Per task (sorted rows of one place and pair of blocks): links, or the rows that signatures leave."""
    limits = bounds(p)

    def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows < 2:
            return
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint32).reshape(t.num_rows, p.hashes)
        side, group = t.column("side").to_numpy(), t.column("grp").to_numpy()
        i, j, m = _survivors(sig, side, group, t.column("place")[0].as_py() if buckets else None, p, limits)
        if not verify:
            some = t.take(pa.array(np.unique(np.concatenate([i, j])), pa.int64())).select(["doc_id", *_TASK, "side", "grp"]).combine_chunks()
            yield from some.to_batches()
        elif pairs := _links(t.column("doc_id").to_numpy(), i, j, m, t.column("shingles").to_pylist(), p):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["u", "v"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in it:
            keys = list(zip(*(batch.column(c).to_pylist() for c in _TASK), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != key:
                    yield from close(held)
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close(held)

    return run


def _blocks(n: Column, shingles: Column, p: NearDedup) -> Column:
    return F.greatest(F.ceil(n / F.lit(p.block)), F.ceil(shingles * 8 / F.lit(p.block_bytes))).cast("int")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks).cast("int")


def _met(docs: DataFrame, meets: DataFrame, p: NearDedup, verify: bool, buckets: bool) -> DataFrame:
    """Runs the tasks of ``meets``: ``doc_id, meets`` (an array of tasks), one row a document."""
    members = docs.join(meets.hint("shuffle_hash"), "doc_id").mapInArrow(_resketch(p, verify), f"doc_id long, meets array<struct<{_TASK_TYPE}>>, signature binary, shingles binary")
    rows = members.select("doc_id", "signature", "shingles", F.explode("meets").alias("m")).select("doc_id", "signature", "shingles", "m.*")
    dealt = rows.repartition(*_TASK).sortWithinPartitions(*_TASK)
    return dealt.mapInArrow(_meeting(p, verify, buckets), "u long, v long" if verify else f"doc_id long, {_TASK_TYPE.replace(':', '')}")


def _gathered(rows: DataFrame) -> DataFrame:
    """Tasks of each document as one array: a document has no more buckets than bands, and each no more than its blocks."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*_TASK, "side", "grp")).alias("meets"))


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """Component of every document under near-duplicate links.

    ``docs``: ``doc_id`` long and ``text``; further columns are ignored. Returns
    one row per input row: ``doc_id, n_shingles, component_id, kept``.

    A null or empty text has no shingles and stands alone. Rows that repeat an
    id are one node: they share a component. A row with a null id links with
    nothing; its component is null and it is kept. An empty table gives an
    empty result.
    """
    docs = keyed_texts(docs)
    sketch = written(docs.mapInArrow(_sketch(p), "doc_id long, n_shingles long, digest binary, bands array<long>"), "sketch")
    # Copies of one text may hold any share of the rows: they are told apart by id or by a salt wherever they are joined.
    sketch = sketch.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    known = sketch.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("head"), F.collect_set("salt").alias("salts")), "classes")
    heads = known.join(classes.select("digest", F.col("head").alias("doc_id")), ["doc_id", "digest"], "left_semi").select("doc_id", "n_shingles", "bands")
    rows = heads.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    least = rows.groupBy("key").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("most")).where("v <> most").select("key", "v")
    shared = written(rows.join(least, "key"), "shared")  # members of buckets that have two or more

    # Each member meets the head it has most buckets in common with.
    edges = shared.where("doc_id <> v").groupBy("doc_id", "v").agg(F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"))
    star = written(edges.groupBy("doc_id").agg(F.max(F.struct("n", -F.col("v"), "n_shingles")).alias("e")).select("doc_id", (-F.col("e.col2")).alias("place"), F.col("e.n_shingles").alias("n_shingles")), "stars")
    sizes = star.groupBy("place").agg(_blocks(F.count("*"), F.sum("n_shingles"), p).alias("blocks"))
    none = F.lit(0).cast("int")
    leaves = star.join(sizes, "place").select("doc_id", "place", _block(F.col("blocks")).alias("lo"), none.alias("hi"), F.lit(1).cast("int").alias("side"), F.col("doc_id").alias("grp"))
    middles = sizes.select(F.col("place").alias("doc_id"), "place", F.explode(F.sequence(none, F.col("blocks") - 1)).alias("lo"), none.alias("hi"), none.alias("side"), F.col("place").alias("grp"))
    first = components(_met(docs, _gathered(leaves.unionByName(middles)), p, True, False))
    first = written(first, "stars-joined")

    # What is left: buckets whose members are not connected yet.
    near = shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("grp"))
    open_ = near.groupBy("key").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), _blocks(F.count("*"), F.sum("n_shingles"), p).alias("blocks")).where("a <> b").select("key", "blocks")
    placed = near.join(open_, "key").withColumn("c", _block(F.col("blocks")))
    # Block c meets every other one: as side 0 in (c, d > c), as side 1 in (d < c, c), and itself in (c, c).
    dealt = placed.select("doc_id", F.col("key").alias("place"), "c", "grp", F.explode(F.sequence(none, F.col("blocks") - 1)).alias("d"))
    tasks = dealt.select("doc_id", "place", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), F.when(F.col("c") > F.col("d"), 1).otherwise(0).cast("int").alias("side"), "grp")
    left = written(_met(docs, _gathered(tasks), p, False, True), "left")
    second = _met(docs, _gathered(left), p, True, True)
    group = first.withColumnRenamed("component", "group")
    both = second.join(group.select(F.col("node").alias("u"), F.col("group").alias("gu")), "u", "left").join(group.select(F.col("node").alias("v"), F.col("group").alias("gv")), "v", "left")
    joined = components(both.select(F.coalesce("gu", "u").alias("u"), F.coalesce("gv", "v").alias("v")))
    joined = joined.select(F.col("node").alias("group"), F.col("component").alias("top"))
    heads_of = classes.join(first.withColumnRenamed("node", "head"), "head", "left").withColumn("group", F.coalesce("component", "head")).join(joined, "group", "left").select("digest", F.explode("salts").alias("salt"), F.coalesce("top", "group").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "digest", "salt").join(heads_of, ["digest", "salt"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole ``documents`` table at the default settings."""
    return near_duplicates(table(spark, sf_dir, "documents"))
