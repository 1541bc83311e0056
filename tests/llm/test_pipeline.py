"""The pipeline stage by stage against plain versions, over a whole small table."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from sentrilake.session import cut
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, text, kept = docs.columns, dict(docs.select("doc_id", "text").collect()), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, FOLDER))
        if name != "packing":
            assert docs.columns == columns
        kept[name] = Counter(r[0] for r in docs.select("doc_id").collect())
    lettered = {d for d, t in text.items() if any(c.isalpha() for c in t or "")}
    assert set(kept["language"]) <= lettered and len(kept["language"]) >= 0.98 * len(lettered)
    assert not [d for d in kept["quality"] if brute.quality_base(text[d])[-1]]
    groups = brute.jaccard([(d, text[d]) for d in kept["quality"]])
    assert set(kept["near_duplicates"]) == {d for d, _, c in groups if d == c}
    assert max(kept["near_duplicates"].values()) == 1
    assert set(kept["mixing"]) <= set(kept["near_duplicates"]) and max(kept["mixing"].values()) <= 3
    want = sum(len(brute.token_rows([(d, text[d])], 2)[0][1]) * n for d, n in list(kept["mixing"].items()))
    assert docs.groupBy().sum("length").first()[0] == want
    assert before.count() == sum(kept["mixing"].values())
