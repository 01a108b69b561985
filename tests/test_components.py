from __future__ import annotations

import random

from tessella.operators.components import connected_components


def brute(pairs):
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    for pairs in (
        [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)],
        [(rng.randrange(300), rng.randrange(300)) for _ in range(180)],
        [(5, 5), (7, 3), (3, 7)],
    ):
        got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
        linked = {x for p in pairs if p[0] != p[1] for x in p}
        assert {r["node"]: r["component"] for r in got.collect()} == {k: v for k, v in brute(pairs).items() if k in linked}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0
