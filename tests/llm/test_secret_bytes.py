import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from cadenza.llm.secrets import all_spans

SECRET = 'password = "abcdefgh12345"'
B64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
URL = lambda b: "".join(f"%{x:02X}" for x in b)
HEX = lambda b: "".join(f"\\x{x:02x}" for x in b)
LINES = lambda s, n, end="\n": end.join(s[k : k + n] for k in range(0, len(s), n))
LONG = "".join(random.Random(1).choices("bcdfghjk ", k=300))
ODD = bytes(range(128, 256))


@pytest.mark.parametrize(
    "code",
    [
        "data=" + B64(SECRET),
        "?q=" + B64(gzip.compress(SECRET.encode())),
        "x=" + B64(zlib.compress(SECRET.encode())),
        *(f"http://h/{'abcd'[:n]}/" + B64(SECRET).rstrip("=") + "/tail" for n in range(1, 5)),
        *(f"{'abcd'[:n]}-" + B64(gzip.compress(SECRET.encode())) for n in range(1, 5)),
        LINES(B64(LONG[:41] + SECRET + LONG), 60),
        LINES(B64(LONG[:41] + SECRET), 12),
        LINES(B64(gzip.compress((LONG + SECRET + LONG).encode())), 76, "\r\n"),
        LINES(B64(LONG[:41] + SECRET + LONG), 60, "\\n"),
        LINES(B64(gzip.compress((LONG + SECRET).encode())), 64, "\n    "),
        B64(SECRET.encode("utf-16")),
        B64(SECRET.encode("utf-16-be")),
        B64(b"\xff" + SECRET.encode("utf-16-le")),
        B64(ODD + SECRET.encode() + ODD),
        B64(b"\x01\x02\x03" * 20 + SECRET.encode()),
        B64(gzip.compress(gzip.compress(SECRET.encode()))),
        B64(bz2.compress(lzma.compress(zlib.compress(SECRET.encode())))),
        B64(ODD + gzip.compress(SECRET.encode())),
        B64(gzip.compress(ODD + SECRET.encode("utf-16-le"))),
        *(wrap(pack(SECRET.encode())) for wrap in (URL, HEX) for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)),
        URL(SECRET.encode("utf-16-le")),
    ],
)
def test_bytes_are_unwrapped(code):
    text = f"see {code} there"
    base, every, _ = all_spans(text)
    found = [s for s in every if s not in base and s[0] == "assign"]
    assert found and all(4 <= a < b <= 4 + len(code) for _, a, b in found)


def test_escaped_streams_end_where_they_end():
    code = URL(gzip.compress(SECRET.encode()))
    text = f"{code} and more %41 {'words ' * 5000}"
    assert all_spans(text)[1] == [("assign", 0, len(code))]


def test_words_hold_nothing():
    rng = random.Random(2)
    text = "\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 30))) for _ in range(5000)) + " x^2 x^3"
    assert all_spans(text)[1] == []
