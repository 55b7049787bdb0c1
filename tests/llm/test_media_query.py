"""The media query corrects and carves through the operator, and validators read structures."""

import hashlib
import struct

import pytest

from cadenza.llm import media as M
from cadenza.llm.packing import PROBE, WordIds, pack

from .test_scans import GIF, png

PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n29\n%%EOF"


def flac(broken=False):
    head = b"\xff\xf8\xc9\xa8\x05"
    return b"fLaC\x80\0\0\x22" + bytes(34) + head + bytes([M._crc8(head) ^ broken]) + b"samples"


@pytest.mark.parametrize("blob,kind", [(PDF, "application/pdf"), (flac(), "audio/flac")])
def test_structures(blob, kind):
    assert [(m.start, m.end, m.kind) for m in M.sniff(blob)] == [(0, len(blob), kind)]


@pytest.mark.parametrize("blob", [PDF.replace(b"startxref\n29", b"startxref\n7"), PDF.replace(b"-1.4", b"-x.4"), flac(True), b"fLaC\x80\0\0\x22" + bytes(60)])
def test_broken_structures(blob):
    assert M.sniff(blob) == []


def test_query_says_what_was_corrected_and_carved():
    import pyarrow as pa

    text = "GIF89a" + GIF[6:].decode("latin-1")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(["x", text, None])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(M._stored(iter([batch]))).to_pylist()
    assert [r["feature"].split(";")[:2] for r in rows] == [["audio/wav", "corrected=1"]] * 3
    assert rows[0]["feature"].endswith("samples=192;embedded=0") and rows[2]["n_bytes"] == 0
    assert rows[0]["media_sha256"] == hashlib.sha256(M.wav(b"x" + b" " * 191)).hexdigest()


def test_carved_bytes_are_named_by_their_digest():
    import pyarrow as pa

    blob = M.wav(M.padded(b"ab" + png()))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([blob], pa.large_binary()), pa.array(["text/plain"]), pa.array([2 + len(png())])], names=["id", "content", "declared", "n_bytes"])
    (row,) = pa.Table.from_batches(M._digested(iter([batch]))).to_pylist()
    assert row["feature"].endswith(f"embedded=1;image/png@2+{len(png())}:{hashlib.sha256(png()).hexdigest()[:16]}")
    assert struct.unpack_from("<I", blob, 40)[0] == row["payload_bytes"]


def test_packing_refuses_another_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    file = public_tokenizers.path("word_bpe_49k.json")
    WordIds(file, 1000).check(PROBE)
    other = Tokenizer.from_file(file)
    other.normalizer = normalizers.Sequence([])
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError, match="does not cut"):
        WordIds(str(tmp_path / "other.json"), 1000).check(PROBE)


def test_long_words_do_not_fill_the_cache():
    import public_tokenizers

    own = WordIds(public_tokenizers.path("word_bpe_49k.json"), 1000)
    for k in range(40):
        own.batch(["abcdefghij" * 2000 + str(k)])
    assert sum(map(len, own)) + sum(map(len, own.parts)) < 64 * 1000 + 50_000
