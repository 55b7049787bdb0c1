"""Language identification by interpolated modified Kneser-Ney models of letters, one per language.

A text is its letters and marks, lower-cased, every run of anything else one
gap; each symbol is predicted from the three before it. Tasks count their
four-grams in numpy, Spark adds them up and derives everything else by joins:
how many left neighbours a shorter gram has, the discounts of each order from
its counts of counts, what a context leaves to the next shorter order, and so
the probability of every gram seen.

A language's probabilities and context weights are sorted arrays of 64-bit
hashes with their values, files in the shared folder that scoring workers map.
A worker looks up each distinct gram of a stretch once per language. The
language of the lowest cross-entropy per symbol is taken; labelled rows set
aside from counting give the temperature that turns cross-entropies into a
probability, and for each language the cross-entropy beyond which a text is
marked as rejected.
"""

from __future__ import annotations

import mmap
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .ngram import _local, _save, _unpack
from .quality import fold
from .storage import dropped, keyed_texts, new_path, spread, table, written

U64 = np.uint64
_K = U64(0xD6E8FEB86659FD93)
#: Bits of a symbol; three of them make one number.
BITS = 21
#: Kinds of entries: grams of 1 to 4 symbols are kinds 1 to 4, a context's weight is that of its grams' length and CONTEXT.
CONTEXT = 16


@dataclass(frozen=True)
class Languages:
    """apart: one in so many labelled rows only calibrates. sample: calibrating rows, about so many at most. keep: the share of a
    language's calibrating rows that is not rejected. stretch: symbols looked up at a time. file: entries of a file. gather: grams a task holds."""

    apart: int = 16
    sample: int = 20_000
    keep: float = 0.995
    stretch: int = 1 << 20
    file: int = 1 << 22
    gather: int = 1 << 20


_TABLE: dict[str, np.ndarray] = {}


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point, 0 for a gap, and which are letters."""
    if not _TABLE:
        lower, letter = np.zeros(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
        for c in range(0x110000):
            if 0x34000 <= c < 0xE0000:  # no letters are assigned there
                continue
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                lower[c], letter[c] = ord(low) if len(low) == 1 else c, True
            elif unicodedata.category(s)[0] == "M":
                lower[c] = c
        _TABLE.update(lower=lower, letter=letter)
    return _TABLE["lower"], _TABLE["letter"]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a block's documents, each led by three gaps and ended by one, the documents' n + 1 offsets into them, and their numbers of letters."""
    lower, letter = _symbols()
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    docs = len(at) - 1
    letters = np.concatenate([[0], np.cumsum(letter[points])])
    spaced = np.zeros(len(points) + 4 * docs, dtype=np.uint32)
    first = at[:-1] + 4 * np.arange(docs)
    spaced[np.arange(len(points)) + np.repeat(4 * np.arange(docs) + 3, np.diff(at))] = lower[points]
    keep = spaced != 0
    keep[1:] |= keep[:-1]  # a gap stays behind a symbol only
    for k in range(3):
        keep[first + k] = True
    sizes = np.concatenate([[0], np.cumsum(keep)])
    return spaced[keep], sizes[np.append(first, len(spaced))], np.diff(letters[at])


def entry(kind: np.ndarray | int, a: np.ndarray | int, s: np.ndarray) -> np.ndarray:
    """Hash of a gram or a context."""
    return hashing.mix(hashing.mix(np.asarray(a).astype(U64) * _K + np.asarray(kind).astype(U64)) + s)


def grams(seq: np.ndarray, at: np.ndarray, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of a block's four-grams: each distinct one's first symbol and last three, in the order of their hashes, which one stands where, and each place's document."""
    place = np.ones(len(seq), dtype=bool)
    for k in range(3):
        place[at[:-1] + k] = False
    places = np.flatnonzero(place)
    for lo in range(0, len(places), stretch):
        t = places[lo : lo + stretch]
        a = seq[t - 3].astype(U64)
        s = (seq[t - 2].astype(U64) << U64(2 * BITS)) | (seq[t - 1].astype(U64) << U64(BITS)) | seq[t]
        _, one, back = np.unique(entry(4, a, s), return_index=True, return_inverse=True)
        yield a[one], s[one], back, np.searchsorted(at, t, side="right") - 1


def _count(p: Languages):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                a, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                _, one, back = np.unique(entry(4, a, s), return_index=True, return_inverse=True)
                n = np.bincount(back, weights=n).astype(np.int64)
                for lo in range(0, len(one), 1 << 16):
                    k = one[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(a[k].astype(np.int64)), pa.array(s[k].astype(np.int64)), pa.array(n[lo : lo + (1 << 16)])], names=["lang", "a", "s", "n"])
            held.clear()

        for batch in it:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                data, offsets = hashing.utf8(batch.column("text").filter(pa.array(langs == lang)))
                for lo, hi in hashing.blocks(offsets, p.stretch):
                    part = offsets[lo : hi + 1]
                    seq, at, _ = symbols(data[part[0] : part[-1]], part - part[0])
                    for a, s, back, _ in grams(seq, at, p.stretch):
                        held.setdefault(lang, []).append((a, s, np.bincount(back)))
                        size += len(a)
                        if size >= p.gather:
                            yield from flush()
                            size = 0
        yield from flush()

    return run


def _order(seen: DataFrame, lower: DataFrame | None, kind: int, floor: float) -> tuple[DataFrame, DataFrame]:
    """Probabilities ``lang, a, s, p`` of the grams ``seen`` (``lang, a, s, c``) and weights ``lang, s, p`` of their contexts."""
    c = F.col("c")
    # What a gram is predicted from, and what it is to the next shorter order.
    if kind == 4:
        context, suffix = F.shiftleft(F.col("a"), 2 * BITS).bitwiseOR(F.shiftright(F.col("s"), BITS)), F.col("s")
    else:
        context, suffix = F.shiftright(F.col("s"), BITS), F.col("s").bitwiseAND((1 << BITS * (kind - 1)) - 1)
    seen = seen.withColumn("context", context)
    n1, n2, n3, n4 = (F.count_if(c == k) for k in range(1, 5))
    y = F.try_divide(n1, n1 + 2 * n2)
    # The three discounts from counts of counts; where those are too few, plain values, and none exceeds its count.
    raw = (1 - 2 * y * F.try_divide(n2, n1), 2 - 3 * y * F.try_divide(n3, n2), 3 - 4 * y * F.try_divide(n4, n3))
    cut = [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(d, F.lit(k / 2)))).alias(f"d{k}") for k, d in enumerate(raw, 1)]
    discounts = seen.groupBy("lang").agg(*cut)
    off = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    less = seen.join(discounts, "lang").withColumn("off", off)
    contexts = less.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("weight"))
    out = less.join(contexts, ["lang", "context"]).select("lang", "a", "s", ((c - F.col("off")) / F.col("total")).alias("own"), "weight", suffix.alias("suffix"))
    if lower is None:
        out = out.withColumn("below", F.lit(floor))
    else:
        out = out.join(lower.select("lang", F.col("s").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
    return out.select("lang", "a", "s", (F.col("own") + F.col("weight") * F.col("below")).alias("p")), contexts.select("lang", F.col("context").alias("s"), F.col("weight").alias("p"))


def _hashed(languages: list[str], files: int):
    number = {lang: k for k, lang in enumerate(languages)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h = entry(b.column("kind").to_numpy(), b.column("a").to_numpy(), b.column("s").to_numpy().astype(U64))
            langs = pa.array([number[x] for x in b.column("lang").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([langs, pa.array((h % U64(files)).astype(np.int32)), pa.array(h.view(np.int64)), b.column("p").cast(pa.float32())], names=["lang", "file", "h", "p"])

    return run


def _store(folder: str):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy().view(U64)
        order = np.argsort(h, kind="stable")
        _save(folder, f"{key[0].as_py()}-{key[1].as_py()}", [h[order], t.column("p").to_numpy()[order]])
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    return run


@dataclass(frozen=True)
class Model:
    """The models' place and the few numbers of calibration; no size here grows with the corpus."""

    folder: str
    files: int
    languages: list[str]
    floor: float
    temperature: float = 1.0
    limits: tuple[float, ...] = ()


class _Arrays:
    """One language's sorted hashes and values, mapped."""

    def __init__(self, model: Model, number: int):
        self.parts = []
        for k in range(model.files):
            try:
                with open(f"{model.folder}/{number}-{k}", "rb") as f:
                    self.parts.append(_unpack(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), (np.uint64, np.float32)))
            except FileNotFoundError:  # no entry fell into this file
                self.parts.append([np.zeros(0, np.uint64), np.zeros(0, np.float32)])
        self.floor = model.floor

    def find(self, h: np.ndarray, none: float) -> np.ndarray:
        out = np.full(len(h), none)
        deal = (h % U64(len(self.parts))).astype(np.int64) if len(self.parts) > 1 else np.zeros(len(h), np.int64)
        for k, (keys, values) in enumerate(self.parts):
            rows = np.flatnonzero(deal == k)
            if len(keys) and len(rows):
                at = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
                there = keys[at] == h[rows]
                out[rows[there]] = values[at[there]]
        return out

    def chance(self, a: np.ndarray, s: np.ndarray, kind: int = 4) -> np.ndarray:
        """Probability of each gram: as stored where it was seen, else its context's weight times that of the shorter gram."""
        if kind == 0:
            return np.full(len(s), self.floor)
        p = self.find(entry(kind, a, s), np.nan)
        new = np.flatnonzero(np.isnan(p))
        if len(new):
            b, t = np.broadcast_to(a, s.shape)[new], s[new]
            context = (b << U64(2 * BITS)) | (t >> U64(BITS)) if kind == 4 else t >> U64(BITS)
            shorter = t & U64((1 << BITS * (kind - 1)) - 1) if kind < 4 else t
            p[new] = self.find(entry(CONTEXT + kind, 0, context), 1.0) * self.chance(np.zeros(1, U64), shorter, kind - 1)
        return p


def _entropies(model: Model, p: Languages, batch: pa.RecordBatch, opened: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows: their cross-entropies (rows by languages) and numbers of letters."""
    if not opened:
        opened += [_Arrays(model, k) for k in range(len(model.languages))]
    data, offsets = hashing.utf8(batch.column("text"))
    for lo, hi in hashing.blocks(offsets, p.stretch):
        part = offsets[lo : hi + 1]
        seq, at, letters = symbols(data[part[0] : part[-1]], part - part[0])
        sums = np.zeros((hi - lo, len(opened)))
        for a, s, back, doc in grams(seq, at, p.stretch):
            for k, arrays in enumerate(opened):
                sums[:, k] -= np.bincount(doc, weights=np.log(arrays.chance(a, s))[back], minlength=hi - lo)
        yield lo, hi, sums / np.maximum(np.diff(at) - 3, 1)[:, None], letters


def _identify(model: Model, p: Languages):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list = []
        names, limits = np.array([*model.languages, "und"], dtype=object), np.array([*model.limits, np.inf])
        for batch in it:
            for lo, hi, cross, letters in _entropies(model, p, batch, opened):
                best, low = np.full(hi - lo, len(model.languages)), np.zeros(hi - lo)
                score = np.zeros(hi - lo)
                if model.languages:
                    best, low = cross.argmin(1), cross.min(1)
                    score = 1 / np.exp((low[:, None] - cross) * model.temperature).sum(1)
                none = letters == 0
                best[none], score[none], low[none] = len(model.languages), 0.0, 0.0
                rejected = none | (low > limits[best])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(low), pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return run


def _measure(model: Model, p: Languages):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list = []
        for batch in it:
            for lo, hi, cross, letters in _entropies(model, p, batch, opened):
                some = np.flatnonzero(letters > 0)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo).take(pa.array(some)), pa.array(list(cross[some]), pa.list_(pa.float64()))], names=["lang", "cross"])

    return run


def fit(labelled: DataFrame, p: Languages = Languages()) -> Model:
    """Models of the languages of ``labelled`` (``doc_id, text, lang``); rows with a null lang teach nothing."""
    spark = labelled.sparkSession
    rows = labelled.where("lang IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = rows.count()
    apart = F.pmod(F.xxhash64(F.lit("apart"), "doc_id", "text"), F.lit(max(p.apart, -(-n // p.sample)))) == 0
    aside = rows.where(apart)
    many = aside.count()
    if many > 2 * p.sample:  # copies of one row are all set aside or none is
        aside = aside.where(F.rand(0) < p.sample / many)
    counted = rows.where(~apart | F.lit(n < 4 * p.apart)).mapInArrow(_count(p), "lang string, a long, s long, n long")
    seen = written(counted.groupBy("lang", "a", "s").agg(F.sum("n").alias("c")), "grams")
    languages = [r["lang"] for r in seen.select("lang").distinct().sort("lang").limit(4097).collect()]
    if len(languages) > 4096:
        raise ValueError("more than 4096 languages: a text is scored by the model of each")
    # Grams of each shorter order count their left neighbours.
    orders, above = {4: seen}, seen.select("lang", "s")
    for k in (3, 2, 1):
        suffix = F.col("s").bitwiseAND((1 << BITS * k) - 1)
        orders[k] = above.groupBy("lang", suffix.alias("s")).agg(F.count("*").alias("c")).select("lang", F.lit(0).cast("long").alias("a"), "s", "c")
        above = orders[k].select("lang", "s")
    kinds = orders[1].select("s").distinct().count()
    floor, lower, parts, made = 1 / (kinds + 1), None, [], [seen]
    for k in (1, 2, 3, 4):
        grams_of, contexts = _order(orders[k], lower, k, floor)
        lower = written(grams_of, "order")
        made.append(lower)
        parts += [lower.select("lang", F.lit(k).alias("kind"), "a", "s", "p"), contexts.select("lang", F.lit(CONTEXT + k).alias("kind"), F.lit(0).cast("long").alias("a"), "s", "p")]
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    size = sum(t.count() for t in made)
    model = Model(_local(new_path(spark, "languages")), max(1, -(-2 * size // (p.file * max(1, len(languages))))), languages, floor)
    hashed = entries.mapInArrow(_hashed(languages, model.files), "lang int, file int, h long, p float")
    hashed.groupBy("lang", "file").applyInArrow(_store(model.folder), "n long").agg(F.sum("n")).collect()
    dropped(*made)
    return _calibrated(model, aside, p)


def _calibrated(model: Model, rows: DataFrame, p: Languages) -> Model:
    """With the temperature that makes the rows' own languages likeliest and each language's limit of cross-entropy; a language without rows has none."""
    if not model.languages:
        return model
    found = rows.mapInArrow(_measure(model, p), "lang string, cross array<double>").toArrow()  # about p.sample rows at most
    number = {lang: k for k, lang in enumerate(model.languages)}
    own = np.array([number.get(x, -1) for x in found.column("lang").to_pylist()], dtype=np.int64)
    cross = np.array(found.column("cross").to_pylist(), dtype=float).reshape(-1, len(model.languages))[own >= 0]
    own = own[own >= 0]
    limits = tuple(float(np.quantile(cross[own == k, k], p.keep)) if (own == k).any() else np.inf for k in range(len(model.languages)))
    steps = 2.0 ** np.linspace(-3, 7, 81)
    right = cross[np.arange(len(own)), own]
    loss = [float(np.log(np.exp((right[:, None] - cross) * t).sum(1)).mean()) if len(own) else 0.0 for t in steps]
    best = float(steps[int(np.argmin(loss))]) if len(own) else 8.0
    return Model(model.folder, model.files, model.languages, model.floor, best, limits)


def identify(docs: DataFrame, model: Model, p: Languages = Languages()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected`` of ``docs`` (``doc_id, held_out, text``); ``rejected`` marks texts without letters and those further from their language than its limit."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
    return docs.select("doc_id", "held_out", "text").mapInArrow(_identify(model, p), schema)


def identify_held_out(docs: DataFrame, held_out: Column | None = None, p: Languages = Languages()) -> DataFrame:
    """Learns from the rows of ``docs`` (``doc_id``, ``text``, ``lang``) that are not ``held_out`` (by default the id's fold of 4 is 2) and identifies all.

    A null text, or one without a letter, is ``und`` with score 0 and rejected;
    marks and lower case follow Unicode. Repeated rows and null ids count and
    are scored each. Of equal cross-entropies the language first in order is
    taken. With nothing to learn from every text is ``und``; an empty table
    gives an empty result; other columns are ignored.
    """
    docs = spread(docs.select("doc_id", "text", "lang"))
    out = fold(F.col("doc_id").cast("long"), 4) == 2 if held_out is None else held_out
    docs = docs.withColumn("held_out", out)
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out"), fit(docs.where(~F.col("held_out")), p), p)


def op12_language(spark, sf_dir: str) -> DataFrame:
    """Languages of the whole ``documents`` table."""
    return identify_held_out(table(spark, sf_dir, "documents"))
