"""Token alignment against whole-text encoding and plain loops over byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cadenza.llm import cuts
from tests.llm.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _plain(text, a, b):
    """Groups of ids and links by sets of ends, both tokenizers over the whole text."""
    if not text:
        return None
    letters = cuts._byte_letters()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ends = []
    for ids, name in ((x, lambda i: bytes(letters[c] for c in a.id_to_token(i))), (y, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        said, at = b"", []
        for i in ids:
            said += name(i)
            at.append(len(said))
        if said != (" " + text).encode():
            return None
        ends.append(at)
    groups, links, i, j = [], [], 0, 0
    last = {e: k for k, e in enumerate(ends[1])}
    for k, e in enumerate(ends[0]):
        if e in last:
            groups.append(",".join(map(str, x[i : k + 1])) + "|" + ",".join(map(str, y[j : last[e] + 1])))
            links.append((x[k], y[last[e]]))
            i, j = k + 1, last[e] + 1
    return x, y, groups, links


def _expected(rows, a, b):
    plain = [(i, _plain(t, a, b)) for i, t in rows]
    counts = Counter(p for _, d in plain if d for p in d[3])
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, d in plain:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n = [counts[p] for p in d[3]]
            out.append((i, len(d[0]), len(d[1]), len(d[2]), len(d[3]), sum(counts[p] == top[p[1]] for p in d[3]), sum(n), hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_whole_text_encoding(spark, documents, tokenizers):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = cuts.op11_token_cuts(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(_expected(rows, *tokenizers))


def test_odd_rows(odd, nothing, tokenizers):
    from tests.llm.conftest import ODD

    got = cuts.align(odd, A, B, digest=True).withColumnRenamed("groups", "groups_sha256").select(*COLUMNS)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_expected(ODD, *tokenizers), key=key)
    assert cuts.align(nothing, A, B).count() == 0


SPACES = ["a  b", " a", "a ", "\n", " \n\n a\tb\r\n c", "\r  x", "a\r b \r\r  c\r", "x  y  z", "　 全角　空", "a\x1c b\x1d", "\x85 a", "it's they'll  'tis", "a▁b", "<|endoftext|> <s> </s>", "\x00 a\x00b", "é́ a", "👩‍👩‍👧 x", "\t\t\tx", "   ", "1234 5678", "aaaa" * 900, "ab\n" * 2000, "".join(map(chr, range(1, 600)))]


def test_chunks_are_safe(tokenizers):
    """Texts full of odd white space: chunk by chunk is the same as whole."""
    r = random.Random(3)
    some = " \n\t\r\v\f\x1c 　 ab'.,1é你▁"
    texts = SPACES + ["".join(r.choice(some) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    pair = cuts.Pair(A, B)
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        counts, said, links, at = pair.batch(part)
        for k, t in enumerate(part):
            want = _plain(t, *tokenizers)
            if want is None:
                assert said[k] == "" and counts[k].sum() == 0 and at[k] == at[k + 1], repr(t)
            else:
                assert said[k] == ";".join(want[2]), repr(t)
                assert counts[k].tolist() == [len(want[0]), len(want[1]), len(want[2])]
                assert links[at[k] : at[k + 1]].tolist() == [x * pair.b_size + y for x, y in want[3]]


def test_packed_words_equal_one_integer():
    import numpy as np

    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 400)
        ends = [sorted({n, *r.sample(range(1, n + 1), r.randint(0, n))}) for _ in range(2)]
        lengths = [list(np.diff([0, *e])) for e in ends]
        want = [(ends[0].index(c) + 1, ends[1].index(c) + 1) for c in sorted(set(ends[0]) & set(ends[1]))]
        for found in (cuts.shared_ranks(*map(np.asarray, lengths)), cuts._packed_ranks(*map(np.asarray, lengths))):
            assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def test_cache_starts_anew(tokenizers):
    pair = cuts.Pair(A, B, cache=3)
    for t in ("one two three", "four five six", "one two seven"):
        assert pair.batch([t])[1] == [";".join(_plain(t, *tokenizers)[2])]


def test_clashing_names_and_wrong_tokenizers(spark):
    df = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string").withColumn("links", F.lit("x")).withColumn("groups", F.lit("y"))
    assert cuts.align(df, A, B).first()["n_groups"] == cuts.align(df.select("doc_id", "text"), A, B).first()["n_groups"] > 0
    with pytest.raises(ValueError):
        cuts.Pair(public_tokenizers.path("word_bpe_49k.json"), B)
