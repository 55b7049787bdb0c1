"""Language models against dictionaries of counts, and accuracy on documents kept apart."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import language as L
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def _seq(text):
    """Symbols of a text by a loop."""
    import unicodedata

    out = []
    for ch in text or "":
        if ch.isalpha() or unicodedata.category(ch)[0] == "M":
            low = ch.lower()
            out.append(low if len(low) == 1 and ch.isalpha() else ch)
        elif out and out[-1] != " ":
            out.append(" ")
    if out and out[-1] != " ":
        out.append(" ")
    return ["^"] * 3 + out


class Plain:
    """Interpolated modified Kneser-Ney over tuples."""

    def __init__(self, texts):
        four = Counter()
        for t in texts:
            s = [c if c != "^" else " " for c in _seq(t)]
            four.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        self.counts = {4: four}
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.off, self.total, self.weight = {}, {}, {}
        for k, counts in self.counts.items():
            n = [sum(v == x for v in counts.values()) for x in range(1, 5)]
            d = []
            for i in (1, 2, 3):
                ok = n[0] + 2 * n[1] and n[i - 1]
                raw = i - (i + 1) * (n[0] / (n[0] + 2 * n[1])) * n[i] / n[i - 1] if ok else i / 2
                d.append(max(0.05, min(i - 0.05, raw)))
            self.off[k] = d
            total, left = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3) - 1]
            self.total[k], self.weight[k] = total, {x: left[x] / total[x] for x in total}

    def chance(self, g, floor):
        k = len(g)
        if k == 0:
            return floor
        lower = self.chance(g[1:], floor)
        if not self.total[k].get(g[:-1]):
            return lower
        c = self.counts[k].get(g, 0)
        return (c - self.off[k][min(c, 3) - 1] if c else 0) / self.total[k][g[:-1]] + self.weight[k][g[:-1]] * lower

    def cross(self, text, floor):
        s = [c if c != "^" else " " for c in _seq(text)]
        return -sum(math.log(self.chance(tuple(s[i - 3 : i + 1]), floor)) for i in range(3, len(s))) / max(1, len(s) - 3)


TEXTS = {
    "aa": ["the small cat sat on the mat", "The cat, the hat; and THE bat!", "a cat and a rat", "mats and hats and cats 123", ""],
    "bb": ["der kleine Hund bellt laut", "Straße und Übung, übel", "die Hunde und der Mond", "das ist der Hund", None],
    "cc": ["नमस्ते दुनिया", "यह एक वाक्य है", "दुनिया एक है"],
}


def _docs(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, texts in TEXTS.items() for t in texts)]
    return spark.createDataFrame([*rows, (90, "not learned at all", None)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("stretch", [7, 64, 1 << 20])
@pytest.mark.parametrize("file", [5, 1 << 20])
def test_model_equals_dictionaries(spark, stretch, file):
    """Any length of stretches and size of files gives the cross-entropies of plain counting."""
    p = L.Languages(stretch=stretch, file=file, gather=50)
    model = L.fit(_docs(spark), p)
    plain = {lang: Plain(texts) for lang, texts in TEXTS.items()}
    assert model.languages == sorted(plain)
    kinds = {g for m in plain.values() for g in m.counts[1]}
    assert model.floor == 1 / (len(kinds) + 1)
    tests = ["the cat", "Der Hund", "दुनिया", "zebra xylophone", "q", "the der", "İstanbul ÀÉ"]
    df = spark.createDataFrame([(i, False, t) for i, t in enumerate(tests)], "doc_id long, held_out boolean, text string")
    for r in L.identify(df, model, p).collect():
        cross = {lang: m.cross(tests[r.doc_id], model.floor) for lang, m in plain.items()}
        best = min(cross, key=cross.get)
        assert r.lang_pred == best and r.cross_entropy == pytest.approx(cross[best], rel=1e-5)
        assert r.score == pytest.approx(1 / sum(math.exp((cross[best] - c) * model.temperature) for c in cross.values()), rel=1e-3)


def test_probabilities_sum_to_one(spark):
    model = L.fit(_docs(spark))
    symbols = sorted({ord(c) if c != " " else 0 for texts in TEXTS.values() for t in texts for c in _seq(t)[3:]} | {ord("~")})
    arrays = L._Arrays(model, 0)
    for a, b, c in ((0, 0, 0), (ord("c"), ord("a"), ord("t")), (ord("z"), ord("z"), ord("a")), (1, 2, 3)):
        s = np.array([(b << 42) | (c << 21) | x for x in symbols], dtype=np.uint64)
        assert arrays.chance(np.full(len(s), a, dtype=np.uint64), s).sum() == pytest.approx(1, abs=1e-4)


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in L.op12_language(spark, SF).collect()}
    return docs.collect(), got


def test_held_out_accuracy(found):
    docs, got = found
    assert len(got) == len(docs)
    right = tried = 0
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred in {"de", "en", "es", "fr"} or not any(c.isalpha() for c in d.text))
        if r.held_out and d.lang is not None and any(c.isalpha() for c in d.text):
            tried += 1
            right += r.lang_pred == d.lang
    assert tried > 150 and right >= 0.97 * tried


def test_rejection_and_calibration(spark, found):
    """Few documents of known languages are rejected, texts of others are."""
    docs, got = found
    held = [got[d.doc_id] for d in docs if got[d.doc_id].held_out]
    assert sum(r.rejected for r in held) <= 0.1 * len(held)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-1, "ЭТО НЕ ВЫУЧЕНО совсем никак и нигде", None), (-2, "xqzj wvkk qqqx zzxw jjjq kkxz wwvq xxqz", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in L.identify_held_out(table.select("doc_id", "text", "lang").unionByName(more)).where("doc_id < 0").collect()}
    assert out[-1].rejected and out[-2].rejected


def test_label_and_source_are_no_inputs(spark, found):
    """Held-out rows with other labels, and labels of rows without one, change nothing."""
    docs, got = found
    table = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed = table.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    for r in L.identify_held_out(changed).where("held_out").collect():
        assert (r.lang_pred, round(r.score, 6)) == (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 6))


def test_odd_rows(spark, odd, nothing):
    langs = F.when(F.col("doc_id") % 2 == 0, "x").when(F.col("doc_id") % 3 == 0, "y")
    got = L.identify_held_out(odd.withColumn("lang", langs)).collect()
    assert len(got) == len(ODD)
    texts = Counter((i, t is not None and any(c.isalpha() for c in t)) for i, t in ODD)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == texts
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    assert L.identify_held_out(nothing.withColumn("lang", F.lit("x"))).count() == 0
    alone = L.identify_held_out(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(alone) == len(ODD) and {r.lang_pred for r in alone} == {"und"}
