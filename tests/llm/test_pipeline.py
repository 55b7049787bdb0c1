"""The pipeline against a brute-force version of its stages."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from cadenza.llm.quality import Quality

from .conftest import SF
from .test_near_stage import brute
from .test_quality_loops import slow_scores
from .test_secret_streams import slowly
from .test_tokens import check_packing


def exact(texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault("".join(t.split(None)) if t.isascii() else "".join(c for c in t if c not in " \t\n\v\f\r"), []).append(i)
    return {min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values()}


def test_run(spark, documents, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = sorted(texts.items())
    scores = slow_scores(rows, {r.doc_id: r.quality for r in labels.collect()}, Quality())
    assert all(abs(x - 0.5) > 0.01 for x in scores)
    left = {i: t for (i, t), x in zip(rows, scores, strict=True) if x >= 0.5}
    left = {i: left[i] for i in exact(left)}
    left = {i: left[i] for i in brute(left, 80)}

    def hide(t):
        out, last = [], 0
        for a, b in sorted((a, b) for _, a, b in slowly([(c, k, k + 1) for k, c in enumerate(t)])):
            if a >= last:
                out += [t[last:a], "[secret]"]
            last = max(last, b)
        return "".join([*out, t[last:]])

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*lib.encode(hide(t), add_special_tokens=False).ids, 0] for i, t in left.items()}
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(want) and 0 < len(want) < len(texts)
    assert check_packing(rows, want, 2048) <= sum(map(len, want.values())) / 2048 + 3
    assert np.all([r.length > 0 for r in rows])


def test_stages_keep_the_columns_of_documents(spark, documents):
    docs = documents
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes, name
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "secrets", "packing"]


def test_stages_on_nothing_and_on_nulls(spark, documents):
    for docs in (documents.limit(0), documents.limit(3).selectExpr("doc_id", "cast(null AS string) AS text", "lang", "source", "n_chars")):
        for _, stage in P.STAGES:
            assert stage(spark, docs, SF).count() <= 3
