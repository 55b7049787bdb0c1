import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm.packing import Packing, WordIds, pack, plan
from cadenza.llm.pieces import Pieces, encode, op3_sentencepiece

from .conftest import ODD, SF

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n, alphabet, seed):
    rng = random.Random(seed)
    wild = lambda: chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0x2FFF), rng.randint(0x300, 0x36F), rng.randint(0x3000, 0xD7FF), rng.randint(0x10000, 0x1FFFF), 32, 32]))
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["".join(wild() for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library():
    p = Pieces(PIECES)
    texts = ["", " ", "a  b", "▁", "▁x ▁", "<s></s><0x0A>", "\n\n", " " * 40 + "a", "ab" * 400, "⁇"] + odd_texts(600, "ab c\n\té▁😀①the in er", 1)
    for text, (ids, said) in zip(texts, p.batch(texts), strict=True):
        want = p.library.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want)) and said == p.library.decode(want), text


def test_both_agendas_agree():
    p = Pieces(PIECES)
    rng = random.Random(2)
    for _ in range(300):
        s = ["▁", *("".join(rng.choice("theringsandofé") for _ in range(rng.randint(1, 40))))]
        assert p._short(list(s)) == p._long(list(s))


def test_a_difference_is_an_error():
    p = Pieces(PIECES)
    p.costs["▁zq"] = -1.0
    p.ids["▁zq"] = 5
    with pytest.raises(ValueError, match="differ"):
        p.batch(["zq"])


def test_small_cache_gives_the_same():
    texts = odd_texts(200, "abc def", 3)
    assert Pieces(PIECES, cache=10).batch(texts) == Pieces(PIECES).batch(texts)


def test_encode_odd_cases(spark, odd, nothing):
    rows = encode(odd, PIECES).collect()
    lib = Pieces(PIECES).library
    assert sorted(((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in rows), key=str) == sorted(((i, len(ids := lib.encode(t or "", add_eos=True)), tuple(ids), lib.decode(ids)) for i, t in ODD), key=str)
    assert encode(nothing, PIECES).count() == 0


def test_query_equals_the_library(spark, texts):
    lib = Pieces(PIECES).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_sentencepiece(spark, SF).collect()}
    want = {i: lib.encode(t, add_eos=True) for i, t in texts.items()}
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(lib.decode(x))) for i, x in want.items()}


def test_word_ids_equal_the_library():
    lib, own = Tokenizer.from_file(WORDS), WordIds(WORDS, 200)
    texts = ["", "  ", "a<|endoftext|>b <|startoftext|>", "it's 12 o'clock!!", "x ́y", "ΑΣ ΑΣ'", "\x1c a", "\x85z", "　q", "ÀÉß÷×"] + odd_texts(800, "aB c\n\té1'st😀ΣÅ̈́\x1f\xa0<|endoftext|>!?", 4)
    for text, ids in zip(texts, own.batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, want, capacity):
    """Pieces are the documents' own, and sequences hold them without gaps or overlaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for i, ids in want.items():
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [(k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    return len(by_sequence)


def test_packing_of_the_tables(spark, documents, texts):
    lib = Tokenizer.from_file(WORDS)
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    n = check_packing(pack(documents, WORDS).collect(), want, 2048)
    assert n <= -(-sum(map(len, want.values())) // 2048) + 2
    check_packing(pack(documents.repartition(7), WORDS, Packing(capacity=64)).collect(), want, 64)


def test_packing_odd_cases(spark, odd, nothing):
    rows = pack(odd, WORDS, with_ids=True).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert len(rows[0].ids) == 4 * rows[0].length
    assert pack(nothing, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 2000) for n in rng.sample(range(1, 101), 12)}
    slots, total = plan(dict(counts), 100)
    taken, filled = {}, {}
    for n, first, copies, base, offset in slots:
        assert first == taken.get(n, 0)
        taken[n] = first + copies
        for s in range(base, base + copies):
            filled.setdefault(s, []).append((offset, n))
    assert taken == counts and len(filled) == total
    for s in filled.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 100
    assert total <= 1.2 * sum(n * c for n, c in counts.items()) / 100 + 2


def test_two_replace_one():
    """Greedy leaves 60 + 30; 30 gives way to 25 + 15, which fill the gap of 40."""
    slots, total = plan({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert sorted(s[0] for s in slots if s[3] == 0) == [15, 25, 60] and total == 2
