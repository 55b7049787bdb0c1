import base64
import bz2
import gzip
import hashlib
import html
import lzma
import random
import re
import struct
import zlib

import pytest

from cadenza.llm import media as M
from cadenza.llm.html import align, expression, extract, main_text, op6_html_text, parse, pattern, wrappers
from cadenza.llm.secrets import Scan, all_spans, base_spans, find_secrets, redact

from .conftest import ODD, SF

SECRET = 'password = "abcdefgh12345"'
B64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
URL = lambda s: "".join(f"%{b:02X}" for b in s.encode())
UNI = lambda s: "".join(f"\\u{ord(c):04x}" for c in s)


def plain_spans(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_base_against_the_patterns_as_given():
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "a.b-c_d/e+f", "x", "\n", "é", "Key", "ſecret"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert sorted(base_spans(t)) == sorted(plain_spans(t)), t


@pytest.mark.parametrize("wrap", [URL, UNI, B64, lambda s: B64(gzip.compress(s.encode())), lambda s: B64(zlib.compress(s.encode())), lambda s: B64(bz2.compress(s.encode())), lambda s: B64(lzma.compress(s.encode())), lambda s: URL(B64(s)), lambda s: B64(B64(B64(s))), lambda s: UNI(URL(B64(s))), lambda s: B64(gzip.compress(URL(UNI(s)).encode())), lambda s: B64(s).rstrip("=").replace("+", "-").replace("/", "_")])
def test_layers(wrap):
    code = wrap(SECRET)
    base, every, layers = all_spans(f"see {code} there")
    assert layers >= 1
    found = [s for s in every if s not in base and s[0] == "assign"]
    assert found and all(4 <= a < b <= 4 + len(code) for _, a, b in found)
    assert set(base) <= set(every)


def test_characters_map_to_their_escapes():
    text = "token%3D%22abcdefghijk%22 x"
    assert all_spans(text)[1] == [("assign", 0, 22)] and text[22:25] == "%22"


def test_cycles_and_bombs_end():
    assert all_spans("%25" * 50)[2] >= 1
    bomb = B64(gzip.compress(b"z" * 3_000_000 + b' secret: "abcdefgh99" ' + b"y" * 3_000_000))
    assert [s[0] for s in all_spans(bomb, Scan(most=1 << 16))[1]] == ["assign"]


def test_secrets_odd_cases(spark, odd, nothing):
    rows = find_secrets(odd).collect()
    assert len(rows) == len(ODD)
    ten = next(r for r in rows if r.doc_id == 10)
    assert (ten.n_assign, ten.n_access, ten.n_hex) == (3, 0, 0) and ten.spans.startswith("assign:0:21,assign:")
    assert next(r for r in rows if r.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert find_secrets(nothing).count() == 0
    clean = {r.doc_id: r.text for r in redact(odd).select("doc_id", "text").where("doc_id IN (1, 10)").collect()}
    assert clean[1] is None and "abcdefgh" not in clean[10] and clean[10].count("[secret]") == 3


def test_secrets_of_the_tables(spark, documents, texts):
    rank = {"assign": 0, "access": 1, "hex": 2}
    for r in find_secrets(documents).collect():
        want = sorted(plain_spans(texts[r.doc_id]), key=lambda s: (s[1], rank[s[0]]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def png():
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


@pytest.mark.parametrize("blob,kind", [(png(), "image/png"), (GIF, "image/gif"), (BMP, "image/bmp"), (gzip.compress(b"x"), "application/gzip"), (M.wav(b"abcd"), "audio/wav"), (b"%PDF-1.4 x %%EOF", "application/pdf")])
def test_sniff_and_carve(blob, kind):
    assert M.corrected(blob, "text/plain") == kind and M.corrected(b"MZ" + blob[2:], "text/plain") == "text/plain"
    inside = b"junk" + blob + b"tail"
    assert [(m.start, m.end, m.kind) for m in M.sniff(inside) if m.kind == kind] == [(4, 4 + len(blob), kind)]
    assert not [m for m in M.sniff(blob[: len(blob) // 2]) if m.kind == kind]


def test_media_odd_cases(spark):
    rows = [(1, None, None), (2, b"", "image/png"), (3, png(), "image/png"), (3, png(), "image/png"), (None, b"x" + png(), None), (4, M.wav(b"pay" + GIF), "text/plain")]
    df = spark.createDataFrame(rows, "id long, content binary, declared string").selectExpr("*", "'?' AS media_type", "'?' AS payload")
    got = M.inspect(df).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert (by[1].media_type, by[1].corrected, by[2].embedded) == ("application/octet-stream", True, [])
    assert by[3].media_type == "image/png" and not by[3].corrected
    assert bytes(by[None].embedded[0].content) == png()
    assert bytes(by[4].payload) == b"pay" + GIF and by[4].embedded[0].media_type == "image/gif"
    assert M.inspect(df.limit(0)).count() == 0


def test_media_of_the_tables(spark, texts):
    for r in M.op7_media_columns(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == 44 + len(payload)


def test_padding():
    assert [len(M.padded(b"x" * n)) for n in (0, 1, 191, 192, 193)] == [192, 192, 192, 192, 384]


def test_html_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op6_html_text(spark, SF).collect():
        a = pages[r.page_id]
        a = a[a.index("<article>") + 9 : a.index("</article>")]
        want = "\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", a)) if t)
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body><div class='menu'><a href=x>m</a></div><div id=c1><p>Hello <b>w</b><p>two<ul><li>a<li>b</ul></div><div class='comments'><p>c</div><footer>f", "Hello w\ntwo\na\nb"),
        ("<article><h1>T</h1><div class='notice'>n</div><p>a&amp;b &lt;c&gt; &eacute;&#233;<script>x<p></script><form>f</form><div class='reader-comments'>no</div></article>", "T\na&b <c> éé"),
        ("<!-- <article>x</article> --><main><p>m</main><aside>s</aside>", "m"),
        ("no tags", "no tags"),
        ("", ""),
        (None, ""),
        ("<nav>only</nav>", ""),
        ("<p>" * 3000 + "x", "x"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<<<>><a", "<<<>><a"),
    ],
)
def test_html_edges(page, text):
    assert main_text(page, None) == text


def test_alignment_makes_optional_repeated_and_slots():
    one, two = (expression(parse(h)) for h in ("<div><h1>same</h1><p>a</p><p>b</p></div>", "<div><h1>same</h1><img><p>c</p></div>"))
    (div,) = align(one[6], two[6])
    kinds = {n[0]: (n[1], n[2]) for n in div[6]}
    assert kinds == {"h1": (False, False), "img": (True, False), "p": (False, True)}
    h1, p = (next(n for n in div[6] if n[0] == t) for t in ("h1", "p"))
    assert h1[6][0][5] == "same" and p[6][0][5] is None
    assert pattern(div) == "<div><h1>same</h1>(<img></img>)?(<p>#</p>)+</div>"


def test_host_wrapper_finds_what_is_not_named(spark):
    rows = [(i, "http://h/x", f"<body><div id=top><a>l</a></div><div id=q{i % 2}><p>{'long text ' * 20}{i}</p></div></body>") for i in range(4)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t == " ".join(f"{'long text ' * 20}{i}".split()) for i, t in got.items())


def test_html_odd_cases(spark):
    rows = [(1, None, None), (2, "no url", ""), (None, "http://a/", "<article>x</article>"), (None, "http://a/", "<article>x</article>"), (3, "http://a/", "<article>" + "w " * 100_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'?' AS host", "'?' AS wrapper", "'?' AS text")
    got = extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 199_999]
    assert extract(df.limit(0)).count() == 0 and wrappers(df).count() == 1
