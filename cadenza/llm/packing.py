"""Best-two-fit packing of token sequences.

A sequence is filled greedily with the longest piece that fits; then its
smallest piece is taken out again when two unpacked pieces fill the widened gap
more tightly. Choices depend only on which lengths are left, so the plan is
made on the histogram of lengths, at most one entry per length up to the
capacity, whatever the number of documents, and each sequence of the plan
stands for as many equal ones as the counts allow. Pieces find their places by
their rank among those of their length, which tasks number on their own and a
table of their counts joins up.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keyed_texts, table, written


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end_id: int = 0
    cache: int = 500_000


#: The tokenizer's cutting pattern for lower-case ASCII and Latin-1 letters.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: White space beyond the ASCII kinds, and controls that Python alone takes for it.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_TO_SPACE = dict.fromkeys((9, 10, 11, 12, 13), " ")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordIds(dict):
    """Little-endian ids of words, made when first asked for: the tokenizer drops white space and no piece crosses it.

    Words of ASCII and Latin-1 letters go straight to the library's merge model,
    by the cuts its pattern makes; all others, and its special tokens, through
    its whole chain. most: words kept.
    """

    def __init__(self, file: str, most: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.most = most
        self.room = 64 * most  # characters that may be kept
        self.parts: dict[str, bytes] = {}
        letters = _byte_letters()
        self.spelt = {c: "".join(letters[b] for b in chr(c).encode()) for c in (*range(33, 127), *range(0xC0, 0x100))}

    def __missing__(self, word: str) -> bytes:
        if _PLAIN(word) and "<|" not in word:
            out = []
            for cut in _CUT.findall(word.lower()):
                ids = self.parts.get(cut)
                if ids is None:
                    ids = self.parts[cut] = array("I", [t.id for t in self.library.model.tokenize(cut.translate(self.spelt))]).tobytes()
                    self.room -= len(cut)
                out.append(ids)
            ids = b"".join(out)
        else:
            ids = array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        self.room -= len(word)
        return ids

    def check(self, texts: list[str]) -> None:
        """Fails where ids of texts are not the library's: another tokenizer may cut or normalise in another way."""
        for text, ids in zip(texts, self.batch(texts), strict=True):
            if array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() != ids:
                raise ValueError(f"the tokenizer does not cut texts as this packing does: {text[:80]!r}")

    def trim(self) -> None:
        """Keeps the words met first, which are the common ones, and lets the memory of the others go."""
        for known in (self, self.parts):
            for w in list(islice(known, self.most // 8, None)):
                del known[w]
            for w in [w for w in known if len(w) > 1024]:
                del known[w]
        self.room = 64 * self.most - sum(map(len, self)) - sum(map(len, self.parts))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self) + len(self.parts) > self.most or self.room < 0:
            self.trim()
        get = self.__getitem__
        return [b"".join(map(get, t.translate(_TO_SPACE).split(" ") if _ODD(t) else t.split())) if t else b"" for t in texts]


#: Texts that cutting, case, spaces, accents, digits, marks and scripts of other tokenizers would show in.
PROBE = ["The cats' 12 dogs won't run; I've said it.", "  Two  spaces\tand\nlines\r\n ", "ÉTÉ été naïve Straße ÀÖØß", "x=1,y=[2];\u00a0z\u2003\u3000w", "你好 мир עולם नमस्ते 😀👍🏽", "<|endoftext|> <pad> A_B-C a.b@c.d http://e.f/g?h=i#j", "𝔘𝔫𝔦 ﬁ ½ Ⅷ é", ""]
assert array("I").itemsize == 4 and sys.byteorder == "little"
_KEPT: dict[str, WordIds] = {}


def _cut(file: str, p: Packing, with_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _KEPT:
            _KEPT[file] = WordIds(file, p.cache)
            _KEPT[file].check(PROBE)
        own, end, part = _KEPT[file], np.array([p.end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        ranks = np.zeros(p.capacity + 1, dtype=np.int64)
        width = 4 * p.capacity
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                rows: list[tuple] = []
                for doc, ids in zip(some.column("doc_id").to_pylist(), own.batch(some.column("text").to_pylist()), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), width)):
                        piece = ids[at : at + width]
                        size = len(piece) // 4
                        rows.append((doc, n, at // 4, size, zlib.crc32(piece), part, ranks[size], piece))
                        ranks[size] += 1
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols[:7], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    arrays.append(pa.array(cols[7], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        own.trim()

    return run


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots ``(length, first rank, copies, first sequence, offset)`` for pieces by length, and the number of sequences.

    counts: pieces of each length, 1 to capacity.
    """
    left = np.zeros(capacity + 2, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(capacity + 2, dtype=np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def below(most: int) -> int:
        """The longest length up to most that is left, or 0."""
        if most < 1:
            return 0
        i = np.flatnonzero(left[1 : most + 1])
        return int(i[-1]) + 1 if len(i) else 0

    while (n := below(capacity)) > 0:
        bin_: list[int] = []
        gap = capacity
        while (n := below(gap)) > 0:
            bin_.append(n)
            left[n] -= 1
            gap -= n
        while gap and bin_:
            small = min(bin_)
            room = gap + small
            pair = _two(left, room, small)
            if pair is None:
                break
            bin_.remove(small)
            left[small] += 1
            for x in pair:
                left[x] -= 1
                bin_.append(x)
            gap = room - sum(pair)
        # As many more like it as every length allows.
        need: dict[int, int] = {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        copies = 1 + min(int(left[x]) // k for x, k in need.items())
        offset = 0
        for x in bin_:
            slots.append((x, int(used[x]), copies, sequences, offset))
            used[x] += copies
            offset += x
        for x, k in need.items():
            left[x] -= (copies - 1) * k
        sequences += copies
    return slots, sequences


def _two(left: np.ndarray, room: int, over: int) -> tuple[int, int] | None:
    """Two left lengths with the largest sum in (over, room], the longer first; None if there are none."""
    have = np.flatnonzero(left[1 : room + 1]) + 1
    if not len(have):
        return None
    # For each longer length the largest partner that fits and is no longer than it.
    at = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1
    partner = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    same = (partner == have) & (left[have] < 2)
    partner = np.where(same, np.where(at >= 1, have[np.maximum(at - 1, 0)], 0), partner)
    total = np.where(partner > 0, have + partner, 0)
    best = int(np.argmax(total))
    return (int(have[best]), int(partner[best])) if total[best] > over else None


def place(pieces: DataFrame, p: Packing) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length``, ``part`` and ``rank`` within (part, length)."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # The histogram has no more rows than the capacity.
    slots, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, p.capacity)
    slots.sort()
    key, first, copies, base, offset = (np.array([s[i] for s in slots], dtype=np.int64) for i in range(5))
    starts = np.searchsorted(key, np.arange(p.capacity + 2))

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, r = b.column("length").to_numpy(), b.column("at").to_numpy()
            order = np.argsort(n, kind="stable")
            at = np.empty(len(n), dtype=np.int64)
            cuts = np.flatnonzero(np.r_[True, n[order][1:] != n[order][:-1]]) if len(n) else []
            for a, e in zip(cuts, [*cuts[1:], len(n)], strict=True):
                rows = order[a:e]
                lo, hi = starts[n[rows[0]]], starts[n[rows[0]] + 1]
                at[rows] = lo + np.searchsorted(first[lo:hi], r[rows], side="right") - 1
            where = {"sequence_id": base[at] + r - first[at], "offset": offset[at]}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v, pa.int64()) for v in where.values())], names=[*keep, *where])

    keep = [c for c in pieces.columns if c not in ("part", "rank")]
    types = dict(pieces.dtypes)
    ranked = pieces.join(before, ["part", "length"]).select(*keep, (F.col("rank") + F.col("before")).alias("at"))
    return ranked.mapInArrow(put, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, p: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``: one row per piece.

    A document is the ids of its text, then the end id; a null or empty text is
    the end id alone. Only a document longer than the capacity is cut. Repeated
    rows and null ids are documents of their own; an empty table gives an empty
    result; columns besides ``doc_id`` and ``text`` are ignored. A tokenizer
    that does not give the ids of ``WordIds`` for ``PROBE`` is an error.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + (", ids binary" if with_ids else "")
    return place(written(keyed_texts(docs).mapInArrow(_cut(tokenizer_file, p, with_ids), schema), "pieces"), p)


def op10_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
