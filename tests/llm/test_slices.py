"""Bounded slices, and what a task holds of long texts."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from sentrilake.llm import language
from sentrilake.llm import slices as slicing
from sentrilake.llm.slices import slices, small_batches, text_slices


def test_slices():
    texts = ["a" * 10, None, "b" * 95, "", "c" * 300, "d" * 40, "e" * 40, "f" * 40]
    batch = pa.RecordBatch.from_pydict({"n": list(range(8)), "text": texts})
    assert [p["n"].to_pylist() for p in slices(batch, size=100)] == [[0, 1], [2, 3], [4], [5, 6], [7]]
    assert [p.num_rows for p in slices(batch, size=10**6, rows=3)] == [3, 3, 2]
    assert [x for _, part in text_slices([batch], size=100) for x in part] == [x or "" for x in texts]
    assert list(slices(batch.slice(0, 0))) == []
    lists = pa.RecordBatch.from_pydict({"ids": [[1] * 30, None, [2], [3] * 9]})
    assert [p.num_rows for p in slices(lists, "ids", size=40)] == [1, 3]
    assert [part for _, part in text_slices([lists], "ids", size=40)][1] == [[], [2], [3] * 9]


def test_long_texts_are_labelled_in_bounded_memory():
    """200 texts of 20 000 words, slice by slice: neither all words nor all posteriors are held."""
    rng = np.random.default_rng(1)
    words = [["the", "and", "house", "water"], ["le", "et", "maison", "eau"]]
    model = language.fit([" ".join(rng.choice(w, 400)) for w in words * 3], ["en", "fr"] * 3)
    texts = [" ".join(rng.choice(words[i % 2], 20_000)) for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    labeller, found = language.Labeller(model), []
    tracemalloc.start()
    for _, part in text_slices([batch], size=language._SLICE_BYTES):
        found += labeller.documents(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for x, _ in found] == ["en", "fr"] * 100
    assert peak < 120 << 20


def test_posteriors_against_enumeration():
    """Forward-backward against the sum over all labellings, and the expected pairs against the same."""
    from itertools import product

    rng = np.random.default_rng(2)
    lengths, k = np.array([5, 3, 1]), 3
    emissions, transitions = rng.random((9, k)).astype(np.float32) + 0.01, rng.normal(size=(k, k))
    posterior, pairs = language._expectations(emissions, lengths, transitions)
    want_pairs, start = np.zeros((k, k)), 0
    for n in lengths:
        weight, marginal, total = np.zeros((k, k)), np.zeros((n, k)), 0.0
        for path in product(range(k), repeat=int(n)):
            w = np.prod([emissions[start + i, y] for i, y in enumerate(path)]) * np.exp(sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                marginal[i, y] += w
            for a, b in zip(path, path[1:]):
                weight[a, b] += w
        assert np.allclose(posterior[start : start + n], marginal / total, atol=1e-5)
        want_pairs += weight / total
        start += n
    assert np.allclose(pairs, want_pairs, atol=1e-5)


def test_arrow_batches_end_at_the_slice_size(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(slicing, "SLICE_BYTES", 100_000)
    try:
        small_batches(spark)
        rows = spark.range(1000).selectExpr("repeat('x', 1000) AS text").coalesce(1)
        found = [r[0] for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 1000 and max(found) <= 110
        spark.conf.set(name, "50k")
        small_batches(spark)
        assert spark.conf.get(name) == "50k"
    finally:
        spark.conf.set(name, before)
