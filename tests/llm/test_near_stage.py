"""The near stage of the pipeline against all pairs at its own threshold."""

import corpus_pipeline as P

from .conftest import SF
from .test_dedup import shingles


def brute(texts, percent):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_links_from_eighty_percent(spark):
    """Of 56 shingles 51 are shared, a similarity of 0.84; 49 are 0.78."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "x", *words[31:]])), (3, " ".join([*words[:10], "x", "y", "z", *words[13:]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near(spark, docs, SF).collect()} == {1, 3}


def test_against_all_pairs(spark, documents, texts):
    left = {r.doc_id for r in P.near(spark, documents, SF).collect()}
    assert left == brute(texts, 80) and left < brute(texts, 85)
