"""Threshold joins and windows against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrilake.llm import hard_negatives
from tests.llm import brute

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("low", [-1e9, -50, 0, 40, 200, 1e9])
def test_candidates(low):
    rng = np.random.default_rng(5)
    rows, anchors = (rng.integers(-9, 9, (n, 13)).astype(float) * np.geomspace(1, 0.1, 13).round(1) // 1 for n in (300, 20))
    thresholds = low + rng.integers(0, 30, 20)
    scores = rows @ anchors.T
    want = {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= thresholds))}
    r, c, s = hard_negatives.candidates(rows, anchors, thresholds)
    assert len(r) == len(want) and set(zip(r.tolist(), c.tolist(), s.tolist())) == want


def mine(spark, rows, divisor=10):
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label int")
    for name in ("shard", "kind", "threshold", "windows", "score", "row"):
        df = df.withColumn(name, F.lit("extra"))
    found = hard_negatives.participants(df, F.col("vec_id"), F.col("label"), F.col("vector"))
    out = hard_negatives.mine_negatives(found, F.col("vec_id") % divisor == 0)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def test_ties_copies_and_negative_scores(spark):
    """Small components, so that most scores are shared; half the rows are copies of one vector."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (rng.integers(-2, 4, 5) if i % 2 else (3, 1, 0, -1, 2))], int(rng.integers(0, 3))) for i in range(200)]
    rows += [(1000, [-50.0] * 5, 7), (1010, [50.0] * 5, 7), (1020, [1.0] * 5, 8)]
    got = mine(spark, rows)
    assert got == brute.negatives([(i, [int(x) for x in v], b) for i, v, b in rows], 10)
    assert {r[0] for r in got}.isdisjoint({1000, 1010, 1020})


def test_rows_that_take_no_part(spark):
    good = [(0, [3.0, 4.0], 1), (1, [3.0, 3.0], 1), (2, [2.0, 1.0], 2), (3, [2.0], 2), (4, [0.0, 0.0], 2)]
    odd = [(None, [3.0, 3.0], 1), (5, None, 1), (6, [3.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 2),
           (9, [2.0, 2.0], None), (1, [3.0, 3.0], 1), (1, [9.0, 9.0], 1)]
    want = [(0, 1, 1, 2, 21, 10)]
    assert mine(spark, good + odd) == want
    assert mine(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    assert mine(spark, [(1, [1.0], 1)]) == [] and mine(spark, [(0, [1.0], 1)]) == []
    empty = spark.createDataFrame([], "vec_id long, vector array<double>, label int")
    none = hard_negatives.participants(empty, F.col("vec_id"), F.col("label"), F.col("vector"))
    assert hard_negatives.mine_negatives(none, F.lit(True)).count() == 0
