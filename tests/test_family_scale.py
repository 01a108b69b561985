from __future__ import annotations

import random
from itertools import combinations

from tessella.operators import versions

KINDS = ["near_duplicate", "a_is_more_complete", "b_is_more_complete", "diverged"]


def plain_families(pairs, count_self=True):
    """{path: (family, completeness, is_tip)} by walking from every node."""
    near, holds = {}, {}
    for a, b, kind in pairs:
        if kind != "diverged":
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
        if kind in ("near_duplicate", "a_is_more_complete"):
            holds.setdefault(a, set()).add(b)
        if kind in ("near_duplicate", "b_is_more_complete"):
            holds.setdefault(b, set()).add(a)

    def reach(edges, x):
        seen, stack = set(), list(edges.get(x, ()))
        while stack:
            if (y := stack.pop()) not in seen:
                seen.add(y)
                stack += edges.get(y, ())
        return seen

    held = {x: reach(holds, x) for x in near}
    out = {}
    for x in near:
        n = held[x] if count_self else held[x] - {x}
        out[x] = (min(reach(near, x) | {x}), len(n), not any(x in held[y] for y in near if y != x))
    return out


def ranked_rows(ranked):
    return {r["path"]: (r["family"], r["completeness"], r["is_tip"]) for r in ranked.collect()}


def test_families_equal_a_plain_walk(spark):
    rng = random.Random(1)
    nodes = [f"d/{k:02d}" for k in range(70)]
    near_share = [(a, b, rng.choices(KINDS, [2, 3, 3, 2])[0]) for a, b in sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(62)})]
    cycle = [("e/1", "e/2", "a_is_more_complete"), ("e/2", "e/3", "a_is_more_complete"), ("e/1", "e/3", "b_is_more_complete"), ("e/3", "e/4", "near_duplicate"), ("e/4", "e/5", "a_is_more_complete")]
    pairs = near_share + cycle
    files = spark.createDataFrame([(p, k) for k, p in enumerate(nodes)], "path string, mtime_ms long")
    table = spark.createDataFrame(pairs, "a string, b string, relationship string")
    for count_self in (True, False):
        assert ranked_rows(versions.families(table, files, count_self)) == plain_families(pairs, count_self)


def test_a_large_family_writes_no_pairs_of_members(spark, monkeypatch):
    paths = [f"p/{k:03d}" for k in range(120)]
    pairs = spark.createDataFrame([(a, b, "near_duplicate") for a, b in combinations(paths, 2)] + [("p/119", "q", "a_is_more_complete")], "a string, b string, relationship string")
    written, real = {}, versions.materialize

    def counted(df, name="step"):
        out = real(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(versions, "materialize", counted)
    files = spark.createDataFrame([(p, 0) for p in [*paths, "q"]], "path string, mtime_ms long")
    got = ranked_rows(versions.families(pairs, files))
    assert got == {p: ("p/000", 121, False) for p in paths} | {"q": ("p/000", 0, False)}
    assert max(written.values()) <= len(paths), written
