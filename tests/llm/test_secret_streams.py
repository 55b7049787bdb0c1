"""Windows of decompressed streams, long texts, and a decoder of one character at a time over the table."""

import base64
import codecs
import gzip
import random
import re
import time
import tracemalloc
import zlib

import pytest

from cadenza.llm.secrets import Scan, all_spans

from .test_scans import plain_spans

SECRET = 'password = "abcdefgh12345"'
B64 = lambda b: base64.b64encode(b).decode()
WORDS = "".join(f"{i} some words, and more; " for i in range(4000)).encode()
NOISE = random.Random(5).randbytes(30_000)


@pytest.mark.parametrize(
    "layer",
    [
        WORDS + B64(NOISE + SECRET.encode()).encode() + WORDS,
        WORDS + gzip.compress(NOISE + WORDS + SECRET.encode()) + WORDS,
        WORDS + gzip.compress(WORDS + gzip.compress(NOISE + SECRET.encode() + NOISE) + WORDS) + WORDS,
        WORDS + SECRET.replace(" ", " " * 5000).encode() + WORDS,
        WORDS[:4090] + "é".encode() * 40 + SECRET.encode() + WORDS,
        NOISE + SECRET.encode("utf-16-le") + NOISE,
    ],
)
def test_windows_of_any_size_give_the_same(layer):
    text = f"see {B64(gzip.compress(layer))} there"
    want = [("assign", 4, len(text) - 6)]
    for most in (1 << 9, 1 << 12, 5000, 1 << 16, 1 << 24):
        assert all_spans(text, Scan(most=most, hold=1 << 20))[1] == want, most


def test_a_stream_in_itself_ends():
    inner = gzip.compress(b"x, " * 9)
    for _ in range(30):
        inner = gzip.compress(inner)
    assert all_spans(B64(inner))[2] >= 20


def test_a_bomb_is_never_held_whole():
    varied = b"".join(b"%d," % i + b"z," * 2000 for i in range(8000))
    bomb = B64(zlib.compress(varied + SECRET.encode()))
    size = len(varied)
    del varied
    tracemalloc.start()
    assert ("assign", 0, len(bomb)) in all_spans(bomb, Scan(most=1 << 18))[1]
    peak = tracemalloc.get_traced_memory()[1] - 3 * len(bomb)
    tracemalloc.stop()
    assert peak < size / 2


@pytest.mark.parametrize("text", ["%41" + "x" * 1_000_000, "\\u0041" + "ab-" * 330_000, "x" * 500_000 + "%" + "y=" * 250_000, "a\n" * 500_000, "x^" * 500_000, "token " * 160_000, "\\" * 1_000_000, "api_key" + " " * 1_000_000])
def test_long_texts_take_linear_time(text):
    def took(t):
        start = time.perf_counter()
        all_spans(t)
        return time.perf_counter() - start

    assert took(text) < max(1.5, 12 * took(text[: len(text) // 4]))
    assert took(text) < 20


def slowly(chars, depth=0):
    """Spans of a list of (character, start, end), by decoders of one step each."""
    text = "".join(c for c, _, _ in chars)
    out = {(k, chars[a][1], chars[b - 1][2]) for k, a, b in plain_spans(text)}
    if depth == 3:
        return out

    def replaced(pattern, decode):
        got, at = [], 0
        for m in re.finditer(pattern, text):
            s, e = chars[m.start()][1], chars[m.end() - 1][2]
            got += chars[at : m.start()] + [(c, s, e) for c in decode(m[0])]
            at = m.end()
        return got + chars[at:] if at else None

    for pattern, decode in (
        (r"(?:%[0-9A-Fa-f]{2})+", lambda x: bytes.fromhex(x.replace("%", "")).decode("utf-8", "replace")),
        (r"(?:\\u[0-9A-Fa-f]{4})+", lambda x: codecs.decode(x, "unicode_escape")),
    ):
        if (got := replaced(pattern, decode)) is not None:
            out |= slowly(got, depth + 1)
    for m in re.finditer("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", text):
        s, e = chars[m.start()][1], chars[m.end() - 1][2]
        for at in range(4):
            body = re.sub("=", "", m[0])[at:].translate({45: "+", 95: "/"})
            body = body[: len(body) - (len(body) % 4 == 1)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            out |= slowly([(c, s, e) for c in raw.decode("latin-1")], depth + 1)
            for k in [m.start() for m in re.finditer(rb"\x1f\x8b\x08", raw)]:
                try:
                    out |= slowly([(c, s, e) for c in gzip.decompress(raw[k:]).decode("latin-1")], depth + 1)
                except (OSError, EOFError, zlib.error):
                    pass
    return out


def test_a_slow_decoder_finds_the_same_in_the_table(texts):
    rng = random.Random(11)
    url = lambda s: "".join(f"%{b:02x}" if rng.random() < 0.7 else chr(b) for b in s.encode())
    uni = lambda s: "".join(f"\\u{ord(c):04x}" for c in s)
    wraps = (url, uni, lambda s: "=" + B64(s.encode()), lambda s: "/" + B64(gzip.compress(s.encode())))
    for t in list(texts.values()):
        t = (t or "")[:700]
        code = f"secret: k{rng.randrange(10**9)}abc "
        for wrap in rng.choices(wraps, k=rng.randint(0, 2)):
            code = wrap(code)
        at = rng.randint(0, len(t))
        t = f"{t[:at]} {code} {t[at:]}"
        assert set(all_spans(t)[1]) == slowly([(c, k, k + 1) for k, c in enumerate(t)]), t
