"""Media columns: signatures, structure checks, type correction and carving.

An Aho-Corasick automaton finds every magic number of a blob in one pass. A
validator for the format then reads the structure at that place, confirms it
and gives the media's length; what it rejects is no media. The hit at byte 0
corrects the declared type, confirmed hits elsewhere are carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keyed_texts, table

#: Magic numbers, the bytes before them, and the format each names.
MAGIC = (
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"BM", 0, "image/bmp"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
)


@dataclass(frozen=True)
class Media:
    """A confirmed medium: [start, end) of the blob, its type, and a wav's samples."""

    start: int
    end: int
    kind: str
    payload: tuple[int, int] | None = None


def _wav(b: bytes, i: int) -> Media | None:
    if b[i + 8 : i + 12] != b"WAVE" or i + 12 > len(b):
        return None
    end = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
    if end > len(b):
        return None
    k, form, data = i + 12, None, None
    while k + 8 <= end:
        name, size = b[k : k + 4], struct.unpack_from("<I", b, k + 4)[0]
        if k + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", b, k + 8)
        elif name == b"data":
            data = (k + 8, k + 8 + size)
        k += 8 + size + size % 2
    if form is None or data is None or form[3] != form[2] * form[4] or form[4] * 8 != form[1] * form[5] or (form[4] and (data[1] - data[0]) % form[4]):
        return None
    return Media(i, end, "audio/wav", data)


def _png(b: bytes, i: int) -> Media | None:
    k, first = i + 8, True
    while k + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, k)
        if k + 12 + size > len(b) or (first and (name != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(b[k + 4 : k + 8 + size]) != struct.unpack_from(">I", b, k + 8 + size)[0]:
            return None
        k, first = k + 12 + size, False
        if name == b"IEND":
            return Media(i, k, "image/png")
    return None


def _gif(b: bytes, i: int) -> Media | None:
    if i + 13 > len(b):
        return None
    flags = b[i + 10]
    k = i + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(k: int) -> int:
        while k < len(b) and b[k]:
            k += 1 + b[k]
        return k + 1

    while k < len(b):
        if b[k] == 0x3B:
            return Media(i, k + 1, "image/gif")
        if b[k] == 0x21:
            k = blocks(k + 2)
        elif b[k] == 0x2C and k + 10 <= len(b):
            f = b[k + 9]
            k = blocks(k + 10 + (3 << (f & 7) + 1 if f & 128 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, i: int) -> Media | None:
    k = i + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        m = b[k + 1]
        size = struct.unpack_from(">H", b, k + 2)[0]
        if size < 2:
            return None
        k += 2 + size
        if m == 0xDA:
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b):
                if b[k + 1] == 0xD9:
                    return Media(i, k + 2, "image/jpeg")
                if b[k + 1] and not 0xD0 <= b[k + 1] <= 0xD7:
                    break
                k += 2
            else:
                return None
    return None


def _gzip(b: bytes, i: int) -> Media | None:
    d = zlib.decompressobj(31)
    try:
        feed, out = b[i:], 1
        while out and not d.eof:
            out = len(d.decompress(feed, 1 << 20))
            feed = d.unconsumed_tail
    except zlib.error:
        return None
    return Media(i, len(b) - len(d.unused_data), "application/gzip") if d.eof else None


def _bmp(b: bytes, i: int) -> Media | None:
    if i + 30 > len(b):
        return None
    size, zero, at, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, i + 2)
    ok = zero == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (40, 108, 124) and 14 + head <= at <= size <= len(b) - i and width > 0 and height
    return Media(i, i + size, "image/bmp") if ok else None


_PDF_HEAD = re.compile(rb"%PDF-[0-9]\.[0-9]")
_PDF_TAIL = re.compile(rb"(?:startxref\s+([0-9]+)\s+)?%%EOF")


def _pdf(b: bytes, i: int) -> Media | None:
    """A header with a version, and a tail; where the tail gives the place of a table, a table or an object has to stand there."""
    if not _PDF_HEAD.match(b, i):
        return None
    for m in _PDF_TAIL.finditer(b, i):
        at = i + int(m[1] or 0)
        if m[1] is None or (at < m.start() and re.match(rb"xref|[0-9]+\s+[0-9]+\s+obj", b[at : at + 32])):
            return Media(i, m.end(), "application/pdf")
    return None


def _zip(b: bytes, i: int) -> Media | None:
    k = b.find(b"PK\x05\x06", i)
    if k < 0 or k + 22 > len(b):
        return None
    size, at, note = struct.unpack_from("<IIH", b, k + 12)
    return Media(i, k + 22 + note, "application/zip") if at + size == k - i and k + 22 + note <= len(b) else None


def _crc8(b: bytes) -> int:
    c = 0
    for x in b:
        c ^= x
        for _ in range(8):
            c = (c << 1 ^ 7 if c & 128 else c << 1) & 255
    return c


def _flac(b: bytes, i: int) -> Media | None:
    """Blocks of metadata by their lengths, then a frame whose header fits its checksum. Frames do not tell their lengths: the medium reaches to the end of the blob."""
    k, last = i + 4, False
    while not last:
        if k + 4 > len(b):
            return None
        last, kind, size = bool(b[k] & 128), b[k] & 127, int.from_bytes(b[k + 1 : k + 4], "big")
        if (kind == 0) != (k == i + 4) or (kind == 0 and size != 34) or kind > 6:
            return None
        k += 4 + size
    if k + 6 > len(b) or b[k] != 0xFF or b[k + 1] & 0xFE != 0xF8 or not b[k + 2] >> 4 or b[k + 2] & 15 == 15 or b[k + 3] & 1 or b[k + 3] >> 4 > 10:
        return None
    number = 1 if b[k + 4] < 128 else 8 - (b[k + 4] ^ 255).bit_length()
    end = k + 4 + number + {6: 1, 7: 2}.get(b[k + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[k + 2] & 15, 0)
    return Media(i, len(b), "audio/flac") if end < len(b) and _crc8(b[k:end]) == b[end] else None


def _ogg(b: bytes, i: int) -> Media | None:
    k = i
    while b[k : k + 4] == b"OggS" and k + 27 <= len(b) and b[k + 4] == 0:
        n = b[k + 26]
        k += 27 + n + sum(b[k + 27 : k + 27 + n])
        if k > len(b):
            return None
    return Media(i, k, "audio/ogg") if k > i else None


def _mp4(b: bytes, i: int) -> Media | None:
    k = i
    while k + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, k)
        if size < 8 or k + size > len(b) or not name.isalnum():
            break
        k += size
    return Media(i, k, "video/mp4") if k > i else None


_CHECKS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "image/bmp": _bmp, "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4}
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, before, kind in MAGIC:
            a.add_word(magic.decode("latin-1"), (len(magic), before, kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(blob: bytes) -> list[Media]:
    """All confirmed media in order of their first byte. A candidate wholly inside a confirmed one is embedded in it and listed too."""
    out, seen = [], set()
    for last, (n, before, kind) in automaton().iter(blob.decode("latin-1")):
        i = last - n + 1 - before
        if i >= 0 and (i, kind) not in seen:
            seen.add((i, kind))
            if m := _CHECKS[kind](blob, i):
                out.append(m)
    return sorted(out, key=lambda m: (m.start, -m.end, m.kind))


def corrected(blob: bytes, declared: str | None) -> str:
    """The type of the medium at byte 0; a declared text stays if nothing is there, all else becomes plain bytes."""
    found = [m for m in sniff(blob) if m.start == 0]
    return found[0].kind if found else declared if declared and declared.startswith("text/") else "application/octet-stream"


def wav(samples: bytes, rate: int = 16000) -> bytes:
    """Mono 8-bit PCM: one byte a sample, stored as it is."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def padded(text: bytes, unit: int = 192) -> bytes:
    return text + b" " * ((-len(text)) % unit or (unit if not text else 0))


def _inspect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = []
        for blob, declared in zip(batch.column("content").to_pylist(), batch.column("declared").to_pylist(), strict=True):
            blob = blob or b""
            found = sniff(blob)
            top = next((m for m in found if m.start == 0), None)
            kind = top.kind if top else declared if declared and declared.startswith("text/") else "application/octet-stream"
            rows.append(
                {
                    "media_type": kind,
                    "corrected": kind != declared,
                    "media_length": top.end if top else None,
                    "payload": blob[slice(*top.payload)] if top and top.payload else None,
                    "embedded": [{"start": m.start, "length": m.end - m.start, "media_type": m.kind, "content": blob[m.start : m.end]} for m in found if m is not top],
                }
            )
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[f.name] for r in rows], f.type) for f in _OUT)], names=["id", *(f.name for f in _OUT)])


_OUT = pa.schema([("media_type", pa.string()), ("corrected", pa.bool_()), ("media_length", pa.int64()), ("payload", pa.binary()), ("embedded", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("content", pa.binary())])))])


def inspect(blobs: DataFrame) -> DataFrame:
    """``id, media_type, corrected, media_length, payload, embedded`` of ``id long, content binary, declared string``.

    Null or empty content is plain bytes with nothing embedded; a null declared
    type counts as wrong. Repeated rows and null ids give a row each, an empty
    table an empty result; other columns are ignored.
    """
    schema = "id long, media_type string, corrected boolean, media_length long, payload binary, embedded array<struct<start: long, length: long, media_type: string, content: binary>>"
    return blobs.select(F.col("id").cast("long").alias("id"), F.col("content").cast("binary").alias("content"), F.col("declared").cast("string").alias("declared")).mapInArrow(_inspect, schema)


def _sounds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as sounds."""
    for batch in it:
        for lo in range(0, batch.num_rows, 64):  # a few blobs at a time
            some = batch.slice(lo, 64)
            raw = [(t or "").encode() for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array([wav(padded(b)) for b in raw], pa.large_binary()), pa.array(["text/plain"] * len(raw), pa.string()), pa.array([len(b) for b in raw], pa.int64())],
                names=["id", "content", "declared", "n_bytes"],
            )


def _digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sniffs and reads back what is stored, by ``_inspect``; only digests leave."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    for batch in it:
        (seen,) = _inspect(iter([batch]))
        rows: dict[str, list] = {k: [] for k in names}
        for blob, kind, changed, length, payload, inner in zip(batch.column("content").to_pylist(), *(seen.column(f.name).to_pylist() for f in _OUT), strict=True):
            at = blob.index(b"data", 36) + 8
            rows["payload_bytes"].append(len(payload))
            rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(payload[-16:]))
            rows["media_bytes"].append(length)
            rows["media_sha256"].append(hashlib.sha256(blob[:length]).hexdigest())
            carved = "".join(f";{m['media_type']}@{m['start'] - at}+{m['length']}:{hashlib.sha256(m['content']).hexdigest()[:16]}" for m in inner)
            rows["feature"].append(f"{kind};corrected={int(changed)};samples={len(payload)};embedded={len(inner)}{carved}")
        kinds = {k: pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64() for k in rows}
        yield pa.RecordBatch.from_arrays([seen.column("id"), batch.column("n_bytes"), *(pa.array(v, kinds[k]) for k, v in rows.items())], names=["doc_id", "n_bytes", *rows])


def _stored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _digested(_sounds(it))


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as 8-bit sound declared as plain text, its type corrected, carved and read back."""
    docs = keyed_texts(table(spark, sf_dir, "documents"))
    return docs.mapInArrow(_stored, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
