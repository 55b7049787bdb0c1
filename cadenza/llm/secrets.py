"""Secret scans through nested encodings.

A worklist holds layers: the text itself, then whatever its URL escapes,
``\\u`` and ``\\x`` escapes, base64 runs, two-byte characters and compressed
bytes unwrap to. Each layer is scanned with the same patterns and searched for
further encodings until nothing new appears; a layer seen before at its place
ends its branch, so cycles stop. Every layer maps its characters to the span of
the original text they came from; a base64 layer maps to the run that held it,
a compressed one to the bytes it was packed in. Decoded bytes are read as
Latin-1, one character a byte: all that is looked for is ASCII or bytes, so
this finds it in any encoding, wherever it begins.

Layers are taken depth first, and a compressed one is read as a stream, window
by window, cut where no pattern reaches across; compressed bytes that go on
behind a window are read on from the stream, opened anew. So a bomb costs time
but no more memory than a few windows for each layer around it.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import keyed_texts, numbered_columns, spread, table

#: Kinds in rank order, their patterns, and the least length of what is kept.
KINDS = ("assign", "access", "hex")
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
_ASSIGN = re.compile(rf"""(?:{_WORDS}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LEAST = 8, 16, 32

_ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|((?:\\x[0-9A-Fa-f]{2})+)")
_ONE_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_LINE_END = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_LINE_END.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}")
#: gzip, zlib, bzip2 and xz streams; characters of two bytes.
_MAGIC = re.compile("\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_WIDE = re.compile("(?:[\x01-\xff]\x00){4,}|(?:\x00[\x01-\xff]){4,}")
#: Decoded bytes need a look if they hold one of the words in lower case, or a byte and a pattern that begins with it.
_WORTH = (b"passw", b"secret", b"token", b"api_key", b"apikey", b"akia")
_WORTH_TOO = [
    (sign, re.compile(pattern.encode("latin-1"), re.S))
    for sign, pattern in ((b"", "[A-Za-z0-9+/_-]{16}"), (b"%", "%[0-9A-Fa-f]{2}"), (b"\\", r"\\[ux]"), (b"\0", _WIDE.pattern), (b"", _MAGIC.pattern), (b"\n", rf"(?:[A-Za-z0-9+/_-]++{_LINE_END.pattern}){{2}}"), (b"\\n", rf"(?:[A-Za-z0-9+/_-]++{_LINE_END.pattern}){{2}}"))
]
#: Characters that no pattern holds.
_BREAK = re.compile(rb"(?<!\0)[,;()<>!?*#@$|~\[\]`](?=[^\0])")


@dataclass(frozen=True)
class Scan:
    """least: base64 characters a run needs. most: bytes of a window of a decompressed stream; results do not depend on
    it as long as ``hold`` windows hold a character that no pattern has. A longer stretch without any, which would have
    to be one run of base64 or hex or of words alone, is read in parts that share ``overlap`` bytes."""

    least: int = 16
    most: int = 1 << 22
    hold: int = 8
    overlap: int = 1 << 12


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind; those too short are dropped."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _LEAST[0]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST[1]]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


class _Layer:
    """pieces: ``(first character, start, end, linear)`` of stretches of the layer: a linear one came from the original
    character by character, another one as a whole. more: the bytes behind a window of a stream. at: its place there.
    stream: a digest of all the stream holds, where that is more than one window."""

    __slots__ = ("at", "firsts", "more", "pieces", "stream", "text")

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]], at: int = 0, more: Callable[[], Iterator[bytes]] | None = None, stream: bytes = b""):
        self.text, self.pieces, self.at, self.more, self.stream = text, pieces, at, more, stream
        self.firsts = [p[0] for p in pieces]

    def place(self, a: int, b: int) -> tuple[int, int]:
        first, start, _, linear = self.pieces[bisect_right(self.firsts, a) - 1]
        last, into, end, even = self.pieces[bisect_right(self.firsts, b - 1) - 1]
        return (start + a - first if linear else start, into + b - last if even else end)

    def part(self, a: int, b: int, to: int) -> list[tuple[int, int, int, bool]]:
        """Pieces of characters a to b as they stand in a layer that has them at ``to``."""
        k, out = bisect_right(self.firsts, a) - 1, []
        while a < b:
            first, start, end, linear = self.pieces[k]
            k += 1
            upto = min(b, self.firsts[k]) if k < len(self.firsts) else b
            out.append((to, start + a - first, start + upto - first, True) if linear else (to, start, end, False))
            to, a = to + upto - a, upto
        return out


def _spliced(layer: _Layer, inner: re.Pattern, decode) -> _Layer | None:
    """The whole layer with its escapes replaced, each character mapped."""
    whole, last, to = layer.text, 0, 0
    text: list[str] = []
    pieces: list[tuple[int, int, int, bool]] = []
    for m in inner.finditer(whole):
        if (got := decode(m)) is None:
            continue
        pieces += layer.part(last, m.start(), to)
        to += m.start() - last
        pieces.append((to, *layer.place(*m.span()), False))
        text += [whole[last : m.start()], got]
        to += len(got)
        last = m.end()
    if not last:
        return None
    text.append(whole[last:])
    return _Layer("".join(text), pieces + layer.part(last, len(whole), to))


def _percent(m: re.Match) -> str | None:
    return unquote_to_bytes(m[0]).decode("utf-8", "replace")


def _percent_bytes(m: re.Match) -> str | None:
    return unquote_to_bytes(m[0]).decode("latin-1")


def _escape_bytes(m: re.Match) -> str | None:
    return bytes.fromhex(m[3].replace("\\x", "")).decode("latin-1") if m[3] else _escape(m)


def _narrow(m: re.Match) -> str | None:
    return m[0].replace("\0", "")


def _escape(m: re.Match) -> str | None:
    if m[1]:
        n = int(m[1], 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None
    if m[2]:
        return bytes.fromhex(m[2].replace("\\u", "")).decode("utf-16-be", "replace")
    return bytes.fromhex(m[3].replace("\\x", "")).decode("utf-8", "replace")


def _opened(head: bytes):
    """A reader of gzip, zlib, bzip2 or xz bytes that begin so."""
    if head[:1] == b"B":
        import bz2

        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        import lzma

        return lzma.LZMADecompressor()
    return zlib.decompressobj(47)


def _broken() -> tuple:
    from lzma import LZMAError

    return (zlib.error, OSError, EOFError, ValueError, LZMAError)


#: Bytes fed to a reader at a time: gzip and zlib, whose readers can be copied and so step back from a fault, and others.
_STEP, _SMALL_STEP = 1 << 12, 1 << 6


def _unpacked(packed: Iterator[bytes], most: int) -> Iterator[bytes]:
    """What compressed bytes hold, at most ``most`` bytes at a time, up to their end or the first fault: all that comes before it, also if only a checksum is wrong."""
    reader, fresh = None, True
    for whole in packed:
        reader = reader or _opened(bytes(whole[:6]))
        copies = hasattr(reader, "copy")
        step = _STEP if copies else _SMALL_STEP
        for at in range(0, len(whole), step):
            feed = whole[at : at + step]
            if fresh and copies:  # most that looks like a stream fails before its first byte
                try:
                    out = reader.decompress(feed, 1)
                except _broken():
                    return
                yield out
                fresh, feed = False, reader.unconsumed_tail
            saved, told = reader.copy() if copies else None, 0
            try:
                for out in _fed(reader, feed, most):
                    told += len(out)
                    yield out
            except _broken():
                if saved is not None:
                    yield from _skipped(_bytewise(saved, feed, most), told)
                return
            if reader.eof:
                return


def _fed(reader, feed: bytes, most: int) -> Iterator[bytes]:
    while True:
        out = reader.decompress(feed, most)
        feed = getattr(reader, "unconsumed_tail", b"")
        if out:
            yield out
        if reader.eof or (not feed and len(out) < most and getattr(reader, "needs_input", True)):
            return


def _bytewise(reader, feed: bytes, most: int) -> Iterator[bytes]:
    """The output of a feed with a fault, up to it."""
    try:
        for k in range(len(feed)):
            yield from _fed(reader, feed[k : k + 1], most)
    except _broken():
        return


def _skipped(parts: Iterator[bytes], n: int) -> Iterator[bytes]:
    for part in parts:
        if n < len(part):
            yield part[n:]
        n = max(0, n - len(part))


def _windows(opened: Callable[[], Iterator[bytes]], scan: Scan) -> Iterator[tuple[int, bytes]]:
    """Windows of a stream and their places in it."""
    held, at = b"", 0
    for part in opened():
        held += part
        if len(held) < scan.most:
            continue
        cut = 0
        for lo in range(len(held), 0, -4096):
            breaks = list(_BREAK.finditer(held, max(0, lo - 4096), min(len(held), lo + 1)))
            if breaks:
                cut = breaks[-1].end()
                break
        if cut:
            yield at, held[:cut]
            at, held = at + cut, held[cut:]
        elif len(held) >= scan.hold * scan.most:
            yield at, held
            at, held = at + len(held) - scan.overlap, held[-scan.overlap :]
    if held:
        yield at, held


def _packed(raw: memoryview) -> int:
    """Length of the stream that ``raw`` begins with; up to the fault where it is broken, all of it where it has no end."""
    reader, at = _opened(bytes(raw[:6])), 0
    try:
        while at < len(raw) and not reader.eof:
            feed = raw[at : at + 4096]
            while True:
                out = reader.decompress(feed, 1 << 20)
                feed = getattr(reader, "unconsumed_tail", b"")
                if reader.eof or (not feed and len(out) < 1 << 20 and getattr(reader, "needs_input", True)):
                    break
            at += 4096
    except _broken():
        return min(at + 4096, len(raw))
    return min(at, len(raw)) - len(reader.unused_data)


def _worth(raw: bytes) -> bool:
    low = raw.lower()
    return any(w in low for w in _WORTH) or any(sign in raw and pattern.search(raw) for sign, pattern in _WORTH_TOO)


def _base64(run: str, scan: Scan) -> Iterator[bytes]:
    """The run decoded from each of four offsets, as other characters may be joined to its front."""
    body = run if run.isalnum() else _LINE_END.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) < scan.least:
        return
    for at in range(4):
        part = body[at : len(body) - ((len(body) - at) % 4 == 1)]
        yield binascii.a2b_base64(part + "=" * (-len(part) % 4))


def _unwrapped(layer: _Layer, scan: Scan) -> Iterator[_Layer]:
    text = layer.text
    for sign, inner, decode, as_bytes in (("%", _ONE_PERCENT, _percent, _percent_bytes), ("\\", _ONE_ESCAPE, _escape, _escape_bytes)):
        if sign in text and (got := _spliced(layer, inner, decode)):
            yield got
            if "\ufffd" in got.text:
                yield _spliced(layer, inner, as_bytes)
    if "\0" in text and (got := _spliced(layer, _WIDE, _narrow)):
        yield got
    for runs in (_BASE64, _WRAPPED) if "\n" in text or "\\n" in text else (_BASE64,):
        for m in runs.finditer(text):
            for raw in _base64(m[0], scan):
                if _worth(raw):
                    yield _Layer(raw.decode("latin-1"), [(0, *layer.place(*m.span()), False)])
    raw = None
    for m in _MAGIC.finditer(text):
        if raw is None:
            raw = memoryview(text.encode("latin-1", "replace"))
        packed = raw[m.start() :]
        opened = lambda packed=packed: _unpacked(chain((packed[:4096], packed[4096:]), layer.more() if layer.more else ()), scan.most)
        place, stream = None, b""
        windows = _windows(opened, scan)
        ahead = next(windows, None)
        while ahead:
            at, window = ahead
            ahead = next(windows, None)
            if place is None:
                place = (0, *layer.place(m.start(), m.start() + (max(1, _packed(packed)) if len(layer.pieces) > 1 or layer.pieces[0][3] else 1)), False)
                if ahead:  # its windows are those of this stream, not of another one that begins alike
                    digest = hashlib.blake2b(digest_size=16)
                    for part in opened():
                        digest.update(part)
                    stream = digest.digest()
            if _worth(window):
                yield _Layer(window.decode("latin-1"), [place], at, lambda opened=opened, n=at + len(window): _skipped(opened(), n), stream)


def all_spans(text: str, scan: Scan = Scan()) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, all spans, and the number of decoded layers; spans sorted by start, then kind, then end."""
    rank = {k: i for i, k in enumerate(KINDS)}
    key = lambda s: (s[1], rank[s[0]], s[2])
    base = sorted(base_spans(text), key=key)
    if not any(c in text for c in "%\\\0") and not any(p.search(text) for p in (_BASE64, _WRAPPED, _MAGIC)):
        return base, base, 0
    mark = lambda x: hashlib.blake2b(f"{x.place(0, len(x.text))}:{x.at}:".encode() + x.stream + x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    top = _Layer(text, [(0, 0, len(text), True)])
    seen, found, layers = {mark(top)}, set(base), 0
    work = [_unwrapped(top, scan)]
    while work:
        got = next(work[-1], None)
        if got is None:
            work.pop()
        # The same decoded text at another place, or as a window of another stream, is another finding; else it is a cycle.
        elif got.text and (own := mark(got)) not in seen:
            seen.add(own)
            layers += 1
            found.update((k, *got.place(a, b)) for k, a, b in base_spans(got.text))
            work.append(_unwrapped(got, scan))
    return base, sorted(found, key=key), layers


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(scan: Scan):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers")}
            for text in batch.column("text").to_pylist():
                base, every, layers = all_spans(text or "", scan)
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(_said(base).encode()).hexdigest())
                rows["spans"].append(_said(every))
                rows["n_layers"].append(layers)
            kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_layers": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[k], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return run


def find_secrets(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers`` of whole texts.

    The counts and ``base_sha256`` are of the text as it stands; ``spans`` adds
    what decoded layers hold, at the place of the code they came from. A null
    or empty text has none. Repeated rows and null ids give a row each, an
    empty table an empty result; other columns are ignored.
    """
    return keyed_texts(docs).mapInArrow(_scan(scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")


def redact(docs: DataFrame, scan: Scan = Scan(), mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``, overlapping spans by one. Nulls stay null."""
    names = docs.columns
    at = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            done = []
            for text in batch.column(at).to_pylist():
                if text:
                    out, last = [], 0
                    for _, a, b in all_spans(text, scan)[1]:
                        if a >= last:
                            out += [text[last:a], mark]
                        last = max(last, b)
                    text = "".join([*out, text[last:]])
                done.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    rows = numbered_columns(spread(docs))
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of the whole ``documents`` table."""
    return find_secrets(table(spark, sf_dir, "documents"))
