"""Nested streams at any window size and time stamp, faults in streams."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from cadenza.llm.secrets import Scan, all_spans

SECRET = b'password = "abcdefgh12345"'
WORDS = "".join(f"{i} some words, and more; " for i in range(1500)).encode()


def _text(raw):
    return f"see {base64.b64encode(raw).decode()} there"


def _found(raw, scan=Scan()):
    text = _text(raw)
    return ("assign", 4, len(text) - 6) in all_spans(text, scan)[1]


@pytest.mark.parametrize("part", range(4))
def test_nested_streams_at_any_time_stamp(part):
    """Compressed noise holds an escape by chance now and then; the layer without it begins as the right one does."""
    lost = []
    for stamp in range(part * 15, part * 15 + 15):
        r = random.Random(stamp)
        inner = gzip.compress(r.randbytes(9000) + SECRET + r.randbytes(3000), mtime=stamp)
        raw = gzip.compress(WORDS + inner + WORDS, mtime=stamp)
        lost += [(stamp, most) for most in (1 << 9, 1 << 12, 5000, 1 << 16, 1 << 22) if not _found(raw, Scan(most=most, hold=1 << 20))]
    assert not lost


def test_an_escape_made_by_hand():
    """The two readings of a stream agree for its first windows only."""
    r = random.Random(1)
    raw = gzip.compress(WORDS + gzip.compress(r.randbytes(20_000) + SECRET, mtime=0) + WORDS, mtime=0)
    # A stored block keeps the escape as it is.
    held = zlib.compressobj(0, zlib.DEFLATED, 31)
    assert _found(held.compress(WORDS + b"%41" + raw) + held.flush(), Scan(most=1 << 9, hold=1 << 20))


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress])
def test_what_stands_before_a_fault_is_found(pack):
    body = pack(b"x, " * 40 + SECRET)
    assert _found(body[:-4] + bytes(4)), "a wrong checksum"
    long = pack(WORDS + SECRET)
    for cut in (3, 8):
        assert _found(long[: len(long) - cut] + bytes(cut))


def test_truncated_streams_of_all_kinds():
    for pack in (gzip.compress, lzma.compress):
        raw = pack(SECRET + b", " + random.Random(2).randbytes(50_000))
        assert _found(raw[: len(raw) // 2])
    assert _found(bz2.compress(SECRET)) and _found(lzma.compress(SECRET))
    assert not _found(bz2.compress(SECRET)[:-20])


def test_streams_within_streams_still_end():
    inner = gzip.compress(WORDS, mtime=0)
    for _ in range(6):
        inner = gzip.compress(WORDS + inner + WORDS, mtime=0)
    assert all_spans(_text(inner), Scan(most=1 << 12))[2] < 5000
