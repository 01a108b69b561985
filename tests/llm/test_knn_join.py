from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import knn_join as K

SCHEMA = "vec_id long, embedding array<double>, label int, query_id int, score string"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def brute(rows, k, every=10):
    """(query, rank, id, score) by all pairs, in whole numbers of any size."""
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, tuple(min(max(math.floor(min(max(1024 * x, -1e30), 1e30)), LOW), HIGH) for x in v)))
    out = []
    strip = lambda v: v[: max((j + 1 for j, x in enumerate(v) if x), default=0)]
    for q, v in {(i, strip(v)) for i, v in whole if i % every == 0}:
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=False)), LOW), HIGH), i) for i, w in whole if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, config=K.KnnConfig(), every=10):
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in K.exact_top_k(df, F.pmod("id", F.lit(every)) == 0, config).collect())


def vectors(seed, n, clusters=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (max(clusters, 1), 8)) * bool(clusters)
    return [(k, (centres[k % len(centres)] + rng.normal(0, 0.3 if clusters else 1, 8)).tolist()) for k in range(n)]


@pytest.mark.parametrize("clusters", [0, 12])
def test_equals_brute_force(spark, clusters):
    rows = vectors(1, 500, clusters)
    config = K.KnnConfig(k=4, queries_per_pivot=4, data_block=40, query_block=8)
    assert run(spark, rows, config) == brute(rows, 4)


def test_null_ties_repeats_lengths_and_ids(spark):
    rows = vectors(2, 120)
    rows += [(200, None), (210, [1.0, None]), (220, [float("nan")] * 8), (230, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(240, []), (250, [0.5, -0.25]), (260, [1.0] * 12), (261, [1.0] * 12), (20, rows[20][1]), (33, rows[33][1]), (33, rows[33][1])]
    rows += [(300 + k, [0.25] * 8) for k in range(40)]  # one vector, many ids
    rows += [(41, [0.125 * j] * 8) for j in range(1, 30)]  # one id, many vectors
    assert run(spark, rows, K.KnnConfig(k=3)) == brute(rows, 3)


def test_scores_beyond_a_long_are_cut(spark):
    rows = [(0, [1e300, 1.0]), (10, [-1e300, 2.0]), (1, [2.0**40, 0.0]), (2, [1e300, 0.0]), (3, [1.5, 2.0]), (20, [2.0**30, 1.0]), (4, [-(2.0**40), 7.0])]
    got = run(spark, rows, K.KnnConfig(k=5))
    assert got == brute(rows, 5)
    assert {s for *_, s in got} >= {LOW, HIGH}


def test_few_rows_no_queries_and_empty(spark):
    rows = vectors(3, 4)
    assert run(spark, rows) == brute(rows, 10) and len(run(spark, rows)) == 3
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == [] and run(spark, []) == []


def test_cells_that_cannot_matter_are_not_met():
    pivots = np.array([[100.0, 0.0], [-100.0, 0.0], [0.0, 100.0]])
    y = K.lay_out(pivots, np.array([50.0, 50.0, 50.0]), np.full(3, 1.0), np.array([5.0, 5.0, 0.0]), np.full(3, 1.0), 4, K.KnnConfig())
    assert y.meets.tolist() == [[True, False, False], [False, True, False], [False, False, False]]
    assert y.copies == 2
