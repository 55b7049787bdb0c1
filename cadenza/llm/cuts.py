"""Alignment of two tokenizers' ids over the same bytes.

A byte-level tokenizer (A) and a sentencepiece model (B) read one text. The
ends of each one's tokens are set bits of an integer, a bit for each byte; AND
of the two leaves the cuts they share, and the number of set bits before a cut
is the rank of the token that ends there, so a cut turns into token ranges.
Tokens that end together at a cut are linked.

Both cut a text before white space, so a text falls into chunks that are
encoded and aligned, many together, and kept by each worker once. Links are
written as one number for a pair of ids, counted by Spark, and looked up in a
second pass over what was written. Of two tokens that end together the shorter is the end of the
longer, so the pairs that can occur are fewer than the bytes of the two
vocabularies' tokens, whatever the corpus: their counts can be broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE
from .storage import keyed_texts, table, written

#: Bytes up to which one integer holds the ends; more take packed words.
SMALL = 2048


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def shared_ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte at which tokens of both end, in order: how many tokens of A and of B have ended with it. ``a``, ``b``: lengths of the tokens, of the same sum."""
    if a.sum() > SMALL:
        return _packed_ranks(a, b)
    ends = []
    for lengths in (a, b):
        bits = 0
        for at in np.cumsum(lengths).tolist():
            bits |= 1 << at
        ends.append(bits)
    first, second = ends
    shared, out = first & second, []
    while shared:
        cut = shared & -shared
        upto = cut | (cut - 1)
        out.append(((first & upto).bit_count(), (second & upto).bit_count()))
        shared ^= cut
    return tuple(np.array(out).T)


def _packed_ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over words of 64 bits, with the set bits before each word summed once."""
    size = (int(a.sum()) + 64) // 64 * 64
    words, before = [], []
    for lengths in (a, b):
        bits = np.zeros(size, dtype=np.uint8)
        bits[np.cumsum(lengths)] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words[-1]), dtype=np.int64)]))
    cuts = np.flatnonzero(np.unpackbits((words[0] & words[1]).view(np.uint8), bitorder="little"))
    word, bit = cuts >> 6, (cuts & 63).astype(np.uint64)
    upto = (~np.uint64(0)) >> (np.uint64(63) - bit)
    return tuple(s[word] + np.bitwise_count(w[word] & upto) for w, s in zip(words, before, strict=True))


class Pair:
    """Tokenizers A (a byte-level JSON file) and B (a sentencepiece model). cache: chunks kept, at most."""

    def __init__(self, a_file: str, b_file: str, cache: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        before = self.a.pre_tokenizer
        if self.a.normalizer is not None or type(before).__name__ != "ByteLevel" or before.add_prefix_space or not before.use_regex:
            raise ValueError(f"{a_file} is not a byte-level tokenizer that cuts before white space")
        letters = _byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in s) for s, i in self.a.get_vocab(with_added_tokens=False).items() if set(s) <= letters.keys()}
        sp = self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes, long = {}, []
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.b_bytes[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.b_bytes[i] = name.replace(SPACE, " ").encode()
                if len(name) > 1:
                    long.append(name)
        self.a_size, self.b_sizes = (np.array([len(t.get(i, b"")) for i in range(max(t) + 1)]) for t in (self.a_bytes, self.b_bytes))
        # Two ids of common vocabularies fit a short number.
        self.kind = np.int32 if len(self.a_size) * sp.get_piece_size() < 1 << 31 else np.int64
        self.mark = sp.piece_to_id(SPACE)
        self.b_size = sp.get_piece_size()
        joined = set("".join(long))
        inside = any(SPACE in p.lstrip(SPACE) for p in long)
        # B joins nothing over a space that follows another symbol, nor over a character that is in no longer piece.
        cut = [c for c in "\t\n\v\f\r " if (not inside if c == " " else c not in joined)]
        other = "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if chr(c).isspace() and chr(c) not in cut)
        self.chunks = re.compile(rf"\s*\S+(?:[{other}]\s*\S*)*|\s+" if cut else r"(?s:.+)").findall
        self.most = cache
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.said: list[str] = []
        self.told = np.zeros((1 << 12, 4), dtype=np.int64)  # tokens of A and B, groups, first link in the pool; -1 groups where bytes differ
        self.pool = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0
        self.room = 64 * self.most

    def _b_ids(self, c: str) -> list[int]:
        """B's ids of a chunk as it stands inside a text. The library puts a space before each text, which a chunk brings itself or is freed of."""
        if c[0] == " ":
            return self.b.encode(c[1:]) if len(c) > 1 else [self.mark]
        ids = self.b.encode(c)
        if ids[:1] != [self.mark]:
            raise ValueError(f"a space before {c[:20]!r} is no piece of its own")
        return ids[1:]

    def learn(self, chunks: list[str]) -> None:
        """Keeps new chunks. They are as safe one behind the other as in a text, so those that end without white space are encoded and aligned together."""
        work = [[c] for c in chunks if c[-1].isspace()]
        safe = [c for c in chunks if not c[-1].isspace()]
        work += [safe[lo : lo + 4096] for lo in range(0, len(safe), 4096)]
        while work:
            part = work.pop()
            if not self._together(part) and len(part) > 1:
                half = len(part) // 2
                work += [part[:half], part[half:]]

    def _together(self, chunks: list[str]) -> bool:
        """False if several chunks do not give back their bytes; a chunk alone is then kept as one that does not."""
        text = "".join(chunks)
        whole = text.encode()
        a, b = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids), np.array(self._b_ids(text), dtype=np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join([self.b_bytes.get(i, b"") for i in b.tolist()]) != whole:
            if len(chunks) == 1:
                self._keep(chunks, [""], np.array([[0, 0, -1, 0]]), np.zeros(0, np.int64))
            return False
        p, q = shared_ranks(self.a_size[a], self.b_sizes[b])
        links = a[p - 1] * self.b_size + b[q - 1]
        # Where each chunk ends, in bytes and among the cuts: no token goes over its end.
        ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks])
        cuts = np.cumsum(self.a_size[a])[p - 1]
        last = np.searchsorted(cuts, ends)
        if len(cuts) <= last[-1] or (cuts[last] != ends).any():
            raise ValueError("a token goes over the end of a chunk")
        x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
        i = j = 0
        groups = []
        for m, n in zip(p.tolist(), q.tolist(), strict=True):
            groups.append(f"{x[i]}|{y[j]}" if m - i == 1 == n - j else f"{','.join(x[i:m])}|{','.join(y[j:n])}")
            i, j = m, n
        at = [0, *(last + 1).tolist()]
        counts = np.stack([np.diff(p[last], prepend=0), np.diff(q[last], prepend=0), np.diff(at), np.array(at[:-1]) + self.used], axis=1)
        self._keep(chunks, [";".join(groups[k:m]) for k, m in zip(at, at[1:], strict=False)], counts, links)
        return True

    def _keep(self, chunks: list[str], said: list[str], counts: np.ndarray, links: np.ndarray) -> None:
        n = len(self.said)
        self.place.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.room -= sum(map(len, chunks))
        self.said += said
        while len(self.told) < len(self.said):
            self.told = np.concatenate([self.told, np.zeros_like(self.told)])
        self.told[n : len(self.said)] = counts
        while self.used + len(links) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(links)] = links
        self.used += len(links)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text its counts (tokens of A and B, groups) and its groups; links of all texts and the texts' n + 1 offsets into them."""
        if len(self.place) > self.most or self.room < 0:
            self._empty()
        split = [self.chunks(" " + t) if t else [] for t in texts]
        if new := set().union(*split).difference(self.place):
            self.learn(list(new))
        where = self.place.__getitem__
        rows = [list(map(where, s)) for s in split]
        counts = np.zeros((len(texts), 3), dtype=np.int64)
        said, links, sizes = [], [], [0]
        say = self.said.__getitem__
        for k, at in enumerate(rows):
            n = self.told[at]
            if not at or n[:, 2].min() < 0:
                said.append("")
                sizes.append(0)
                continue
            counts[k] = n[:, :3].sum(0)
            said.append(";".join(map(say, at)))
            # Every chunk's stretch of the pool, one after the other.
            ends = np.cumsum(n[:, 2])
            links.append(self.pool[np.arange(ends[-1]) + np.repeat(n[:, 3] - ends + n[:, 2], n[:, 2])])
            sizes.append(int(ends[-1]))
        return counts, said, np.concatenate(links) if links else np.zeros(0, np.int64), np.cumsum(sizes)


_KEPT: dict[tuple[str, str], Pair] = {}


def _encode(a_file: str, b_file: str, digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_file, b_file) not in _KEPT:
            _KEPT[a_file, b_file] = Pair(a_file, b_file)
        own = _KEPT[a_file, b_file]
        for batch in it:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                counts, said, links, at = own.batch(part.column("text").to_pylist())
                if digest:
                    said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(links.astype(own.kind)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
                )

    return run


def _weigh(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()  # a worker that has encoded needs its chunks no more
        keys, count, best = shared.value
        for batch in (b.slice(lo, 512) for b in it for lo in range(0, b.num_rows, 512)):
            links = batch.column("links")
            at = np.asarray(links.offsets)
            flat = np.searchsorted(keys, np.asarray(links.values)[at[0] : at[-1]])
            at = at - at[0]
            sums = []
            for what in (best, count):
                upto = np.concatenate([[0], np.cumsum(what[flat], dtype=np.int64)])
                sums.append(pa.array(upto[at[1:]] - upto[at[:-1]]))
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(at).astype(np.int64)), *sums, batch.column("groups")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return run


def cut(docs: DataFrame, pair: Pair, files: tuple[str, str], digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links`` of whole texts, A over a space and the text, B over the text.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, ids between shared cuts, or with
    ``digest`` its SHA-256; a link is A's id times the size of B's vocabulary
    plus B's id. A text that is null or empty, or whose bytes one of the two
    does not give back, has no tokens: zeros, an empty text and no links.
    """
    kind = "int" if pair.kind is np.int32 else "long"
    return keyed_texts(docs).mapInArrow(_encode(*files, digest), f"doc_id long, n_a long, n_b long, n_groups long, groups string, links array<{kind}>")


def pair_counts(cuts: DataFrame, b_size: int) -> DataFrame:
    """``link, a_id, b_id, n, best``: links of all rows by pair of ids, and whether a pair is its B id's most frequent (ties included)."""
    counted = cuts.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counted = counted.select("link", F.floor(F.col("link") / b_size).alias("a_id"), (F.col("link") % b_size).alias("b_id"), "n")
    top = counted.groupBy("b_id").agg(F.max("n").alias("top"))
    return counted.join(top, "b_id").select("link", "a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of whole texts.

    ``n_links``: pairs of tokens that end at one byte; ``n_best``: those whose
    pair of ids is the one their B id is linked by most often in all rows, ties
    included; ``count_sum``: sum of their pairs' links in all rows. Repeated
    rows and null ids count and give a row each; null and empty texts give
    zeros; an empty table gives an empty result; other columns are ignored.
    """
    spark, pair = docs.sparkSession, Pair(a_file, b_file)
    cuts = written(cut(docs, pair, (a_file, b_file), digest), "cuts")
    # As many rows at most as the vocabularies' tokens have bytes, whatever the corpus.
    found = pair_counts(cuts, pair.b_size).select("link", "n", "best").toArrow().sort_by("link")
    shared = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("link", "n", "best")))
    return cuts.mapInArrow(_weigh(shared), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def op11_token_cuts(spark, sf_dir: str) -> DataFrame:
    """Alignment of the whole ``documents`` table."""
    import public_tokenizers

    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")
