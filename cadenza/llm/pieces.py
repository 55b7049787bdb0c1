"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols stand in a linked list; every adjacent pair whose joined
string is a piece waits in an agenda ordered by score, then position. The best
is merged and its new neighbours join the agenda.
Symbols outside the vocabulary become byte pieces.

No piece crosses a place where a space mark follows another symbol, or a
symbol found in no longer piece, so a text falls into chunks that cannot
affect each other. Each worker keeps the chunks it has encoded. All chunks new
to a batch are checked against the sentencepiece library in one call, and a
difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import keyed_texts, table

#: The library's mark for a space.
SPACE = "▁"
_NEVER = float("inf")


class Pieces:
    """Encoder and decoder of one model file. cache: chunks kept, at most."""

    def __init__(self, model_file: str, cache: int = 800_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.library
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.costs = {self.names[i]: -sp.get_score(i) for i in normal}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = sp.unk_id()
        self.sounds = [None if sp.is_byte(i) else "" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else self.names[i].replace(SPACE, " ") for i in range(n)]
        self.eos = sp.eos_id()
        long = [p for p in self.ids if len(p) > 1]
        joined = set("".join(long))
        inside = any(SPACE in p.lstrip(SPACE) for p in long)
        lone = "".join(re.escape(c) for c in map(chr, range(0x20)) if c not in joined)
        # A chunk: space marks and what follows them, or one lone control character.
        cut = f"[{lone}]" if lone else "(?!)"
        solid = f"[^{SPACE}{lone}]"
        self.chunks = re.compile(f"{cut}|{SPACE}*{solid}+|{SPACE}+" if not inside else "(?s:.+)").findall
        self.cache: dict[str, str] = {}
        self.changed: dict[str, str] = {}
        self.most = cache
        self.room = 64 * cache  # characters of chunks that may be kept

    def normalise(self, text: str) -> str:
        """As an identity normaliser with a dummy prefix and kept spaces does."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk by the agenda."""
        sym = list(chunk)
        if len(sym) > 1:
            sym = self._short(sym) if len(sym) <= 48 else self._long(sym)
        out: list[int] = []
        known, ids = self.ids.get, out.append
        for s in sym:
            if (i := known(s)) is not None:
                ids(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                ids(self.unknown)
        return out

    def _short(self, sym: list[str]) -> list[str]:
        """The agenda as a flat list of the pairs' costs: for a word it is quicker than a heap."""
        cost = self.costs.get
        agenda = [cost(a + b, _NEVER) for a, b in zip(sym, sym[1:], strict=False)]
        while agenda and (best := min(agenda)) < _NEVER:
            i = agenda.index(best)
            p = sym[i] = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(p + sym[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(sym[i - 1] + p, _NEVER)
        return sym

    def _long(self, sym: list[str]) -> list[str]:
        n, costs = len(sym), self.costs
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(costs[p], i, i + 1, p) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in costs]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, p = heapq.heappop(agenda)
            if right[i] != j or sym[i] + sym[j] != p:
                continue  # one side has been merged meanwhile
            sym[i], sym[j] = p, ""
            k = right[i] = right[j]
            right[j] = -2
            if k >= 0:
                left[k] = i
                if (q := p + sym[k]) in costs:
                    heapq.heappush(agenda, (costs[q], i, k, q))
            h = left[i]
            if h >= 0 and (q := sym[h] + p) in costs:
                heapq.heappush(agenda, (costs[q], h, i, q))
        return [s for s in sym if s]

    def say(self, ids: list[int]) -> str:
        """Text of ids with space marks turned into spaces; runs of byte pieces are decoded together."""
        spoken = self.sounds
        try:
            return "".join([spoken[i] for i in ids])
        except TypeError:  # a byte piece has no text of its own
            pass
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                held.append(self.bytes_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append(spoken[i])
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks that are new, and checks every one against the library."""
        new = list(chunks)
        mine = [self.merge(c) for c in new]
        # The library puts a mark before each text: a chunk that starts with one goes without it, others are compared behind it.
        led = [c[0] == SPACE and c != SPACE for c in new]
        theirs = self.library.encode([(c[1:] if k else c).replace(SPACE, " ") for c, k in zip(new, led, strict=True)], num_threads=1)
        for c, k, ids, sure in zip(new, led, mine, theirs, strict=True):
            if (ids if k else self.merge(SPACE + c)) != sure:
                raise ValueError(f"the agenda and the library differ on {c!r}")
            self.cache[c] = " ".join(map(str, ids))
            self.room -= len(c)
            if (said := self.say(ids)) != c.replace(SPACE, " "):
                self.changed[c] = said

    def batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text: its ids with the end id, as decimals joined by spaces, and the text they decode to."""
        if len(self.cache) > self.most or self.room < 0:
            self.cache.clear()
            self.changed.clear()
            self.room = 64 * self.most
        split = [self.chunks(self.normalise(t)) if t else [] for t in texts]
        if new := set().union(*split).difference(self.cache):
            self.learn(new)
        ids, end = self.cache.__getitem__, str(self.eos)
        return [(" ".join([*map(ids, s), end]), self._spoken(s)) if s else (end, "") for s in split]

    def _spoken(self, chunks: list[str]) -> str:
        """Chunks that decode to themselves, nearly all, are not kept twice."""
        if self.changed and not self.changed.keys().isdisjoint(chunks):
            chunks = [self.changed.get(c, c) for c in chunks]
        return "".join(chunks).replace(SPACE, " ")[1:]


def _utf8(b: bytes) -> str:
    """Each byte that starts no valid character becomes one replacement mark, as in the library."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(b):
            for k in (1, 2, 3, 4):
                try:
                    out.append(b[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_KEPT: dict[str, Pieces] = {}


def _encode(model_file: str, texts_too: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _KEPT:
            _KEPT[model_file] = Pieces(model_file)
        own = _KEPT[model_file]
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                done = own.batch(part.column("text").to_pylist())
                arrays = [part.column("doc_id"), pa.array([a.count(" ") + 1 for a, _ in done], pa.int64())]
                names = ["doc_id", "n_tokens"]
                if texts_too:
                    arrays += [pa.array([[int(x) for x in a.split()] for a, _ in done], pa.list_(pa.int32())), pa.array([d for _, d in done], pa.string())]
                    names += ["ids", "decoded"]
                else:
                    arrays += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in col], pa.string()) for col in zip(*done, strict=True)]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of whole texts, with an end id only.

    A null or empty text has the end id alone and decodes to an empty text.
    Repeated rows and null ids give a row each; an empty table gives an empty
    result; columns besides ``doc_id`` and ``text`` are ignored.
    """
    return keyed_texts(docs).mapInArrow(_encode(model_file, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts of the whole ``documents`` table."""
    import public_tokenizers

    docs = keyed_texts(table(spark, sf_dir, "documents"))
    return docs.mapInArrow(_encode(public_tokenizers.path("piece_bpe_32k.model"), False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
