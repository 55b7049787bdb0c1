import collections
import math
import re
import zlib

import numpy as np

from cadenza.llm.ngram import Ngrams, fit, score, score_held_out
from cadenza.llm.quality import Quality, classify, train

from .conftest import ODD, SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^ \t-\r]+", (text or "").translate(LOWER))


def brute(texts):
    """Scores of an interpolated modified Kneser-Ney bigram model with plain dictionaries."""
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    c, pairs = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if fold[i] != 1:
            w = [*words(t), "</s>"]
            c.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    cont = collections.Counter(w for _, w in pairs)
    context = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in pairs.items():
        context[a][0] += k
        context[a][min(k, 3)] += 1

    def discounts(values):
        m = collections.Counter(min(x, 5) for x in values)
        y = m[1] / (m[1] + 2 * m[2])
        return [0] + [k - (k + 1) * y * m[k + 1] / m[k] for k in (1, 2, 3)]

    d, e, links = discounts(pairs.values()), discounts(cont.values()), len(pairs)
    m = collections.Counter(min(x, 3) for x in cont.values())
    floor = sum(e[k] * m[k] for k in (1, 2, 3)) / links / (v + 1)
    low = lambda w: max(cont[w] - e[min(cont[w], 3)], 0) / links + floor

    def p(a, w):
        if a not in context:
            return low(w)
        t = context[a]
        return max(pairs[a, w] - d[min(pairs[a, w], 3)], 0) / t[0] + sum(d[k] * t[k] for k in (1, 2, 3)) / t[0] * low(w)

    assert abs(sum(p("the", w) for w in [*c, "never seen"]) - 1) < 1e-9
    out = {}
    for i, t in texts.items():
        w = [*words(t), "</s>"]
        out[i] = (fold[i] == 1, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)))
    return out


def test_scores_against_dictionaries(spark, documents, texts):
    want = brute(texts)
    small = Ngrams(gather=20_000, least_buckets=5, sketch=1 << 10, block_bytes=1 << 16)  # many flushes, blocks and frequent contexts
    for p in (Ngrams(), small):
        for r in score_held_out(documents.repartition(5), p).collect():
            got = (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
            assert got[:4] == want[r.doc_id][:4] and np.allclose(got[4:], want[r.doc_id][4:], rtol=1e-9)


def test_scores_of_odd_cases(spark, odd, nothing):
    rows = score_held_out(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1} and next(r for r in rows if r.doc_id == 9).n_tokens == 60_001
    assert score_held_out(nothing).count() == 0
    untaught = score(odd.selectExpr("doc_id", "true AS held_out", "text"), fit(nothing)).collect()
    assert len(untaught) == len(ODD) and {r.train_tokens for r in untaught} == {0}


def test_quality_on_held_out_rows(spark):
    d = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_do_not_matter(spark, documents):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    swapped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in classify(documents, x).collect()) for x in (labels, swapped))
    assert a == b


def test_quality_odd_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (None, 1), (6, None), (10, 0), (99, 1), (11, 7)], "doc_id long, quality int")
    rows = classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in classify(odd, labels.limit(0)).collect()} == {0.5}
    assert classify(nothing, labels).count() == 0


def test_temperature():
    """Labels that are noise in part need a temperature over that of clean ones."""
    rng = np.random.default_rng(0)
    p = Quality(dims=2, epochs=40)
    x = rng.normal(size=(3000, p.features)).astype(np.float32)
    clean = (x[:, 0] > 0).astype(int)
    noisy = np.where(rng.random(3000) < 0.3, 1 - clean, clean)
    net = train(x, noisy, p)
    assert net.temperature > 1 and 0.2 < np.mean(net.score(x[clean == 0])) < 0.45
