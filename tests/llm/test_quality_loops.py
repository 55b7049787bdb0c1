"""The classifier against loops: words by a regular expression, context vectors, poolings, network and temperature one number at a time."""

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import hashing
from cadenza.llm.quality import Quality, classify, train

from .conftest import SF

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = 1 << 64


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % U
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % U
    return x ^ (x >> 31)


def kind(b):
    return 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 if b >= 128 else b


_VALUES = [int(v) for v in hashing._VALUES]
_HASHES: dict = {}


def units(raw, p):
    """Of each word its row, its shape's row, and both hashes."""
    out = []
    for w in re.findall(rb"[^ \t-\r]+", raw):
        if w not in _HASHES:
            h = mix(sum(_VALUES[b] * pow(hashing._P, k + 1, U) for k, b in enumerate(w)) * pow(hashing._P, -1, U) % U)
            shape = ((kind(w[0]) * 256 + kind(w[min(1, len(w) - 1)])) * 256 + kind(w[max(len(w) - 2, 0)])) * 256 + kind(w[-1])
            s = mix(shape + (1 << 40))
            _HASHES[w] = (h % p.word_rows, s % p.shape_rows + p.word_rows, h, s)
        out.append(_HASHES[w])
    return out


def contexts(texts, p):
    table = collections.defaultdict(lambda: [0] * p.dims)
    for t in texts:
        u = units((t or "").encode(), p)
        for i in range(len(u)):
            for j in range(max(0, i - p.window), min(len(u), i + p.window + 1)):
                if i != j:
                    for r in (0, 1):
                        for k in range(p.marks):
                            x = mix((u[j][2 + r] + 0x1234567 * (k + 1)) % U)
                            table[u[i][r]][(x >> 8) % p.dims] += 1 if x & 1 else -1
    return {r: [x / max(math.sqrt(sum(y * y for y in v)), 1e-9) for x in v] for r, v in table.items()}


def features(text, table, p):
    raw = (text or "").encode()
    u = units(raw, p)
    if not u:
        return [0.0] * p.features
    out, none = [], [0.0] * p.dims
    for r in (0, 1):
        v = [table.get(x[r], none) for x in u]
        mean = [sum(c) / len(v) for c in zip(*v, strict=True)]
        out += mean
        out += [math.sqrt(max(sum(a * a for a in c) / len(v) - m * m, 0)) for c, m in zip(zip(*v, strict=True), mean, strict=True)]
        out += [sum(abs(b - a) for a, b in zip(c, c[1:], strict=False)) / max(len(v) - 1, 1) for c in zip(*v, strict=True)]
    same = sum(a[0] == b[0] for a, b in zip(u, u[1:], strict=False)) / len(u)
    return [*out, same, math.log1p(len(u)), math.log1p(len(raw) / len(u))]


def slow_scores(texts, labels, p):
    """Scores of a list of (id, text): training is the seeded one of numpy, all around it loops."""
    table = contexts([t for _, t in texts], p)
    x = [(i, features(t, table, p)) for i, t in texts]
    by_id = dict(x)
    learnt = sorted((i, q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1 and i in by_id)
    net = train(np.array([by_id[i] for i, _ in learnt], dtype=np.float32), np.array([q for _, q in learnt]), p)

    def logit(row):
        hidden = [math.tanh(sum((a - m) / s * w for a, m, s, w in zip(row, net.mean, net.scale, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(p.hidden)]
        return sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2

    # The temperature: of 61 in steps of one ratio the one with the least loss on the rows set aside.
    order = np.random.default_rng(p.seed).permutation(len(learnt))
    aside = [(logit(by_id[learnt[k][0]]), learnt[k][1]) for k in order[: int(len(order) * p.calibration)]]
    steps = [0.25 * 32 ** (k / 60) for k in range(61)]
    loss = lambda t: sum(math.log1p(math.exp(-abs(z / t))) + max(0, (-1 if q else 1) * z / t) for z, q in aside)
    assert math.isclose(min(steps, key=loss), net.temperature, rel_tol=0.13)
    return [1 / (1 + math.exp(-max(-40, min(40, logit(r) / net.temperature)))) for _, r in x]


def test_scores_against_loops(spark):
    p = Quality()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.score for r in classify(docs, labels, p).collect()}
    want = slow_scores(rows, {r.doc_id: r.quality for r in labels.collect()}, p)
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want, strict=True):
        assert abs(got[i] - w) < 2e-3, i


def test_labels_without_a_document_take_no_place(spark):
    """The bound is on labels of documents that are there: the model is the same with many labels of others."""
    from cadenza.llm.quality import Quality, classify

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    others = spark.range(10_000_000, 10_003_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    p = Quality(sample=40)
    one, two = ({r.doc_id: r.score for r in classify(docs, rows, p).collect()} for rows in (labels, labels.unionByName(others.select("doc_id", F.col("quality").cast(dict(labels.dtypes)["quality"]).alias("quality")))))
    assert one == two and len(set(one.values())) > 10
