from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from tessella.llm.jaccard_join import JoinConfig, _buckets, jaccard_components
from tests.test_components import brute


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def expected(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, i) for i in range(len(rows))]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                pairs.append((i, j))
    label = brute(pairs)
    least: dict[int, int] = {}
    for k, (key, _) in enumerate(rows):
        least[label[k]] = min(least.get(label[k], key), key)
    return sorted((key, len(s), least[label[k]]) for k, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed: int) -> list[tuple[int, str | None]]:
    """Unrelated texts, families with edits around the threshold, shared passages, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    texts: list[str | None] = [None, "", " \n", "one", "One", "a b c d", "A  b\tc d", "a b c d e", "É x", "é x", "lone " * 300, "lone " * 299]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 160))]
        if rng.random() < 0.4:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def run(spark, rows, config=JoinConfig(), parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(tuple(r) for r in jaccard_components(docs, config).select("doc_id", "n_shingles", "component_id").collect())


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == expected(rows)


def test_frequent_shingles_long_prefixes_and_joins_without_broadcast(spark):
    rows = corpus(2)
    config = JoinConfig(frequent=2, sketch_bits=8, broadcast_keys=0)
    assert run(spark, rows, config, 5) == expected(rows)


def test_repeated_null_and_clashing(spark):
    rows = [(3, "a b c d e f g", 1, "x"), (3, "a b c d e f g", 1, "x"), (None, "a b c d e f g", 1, "x"), (None, "lone one", 1, "y"), (5, None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id int, component string")
    got = sorted(map(str, (tuple(r) for r in jaccard_components(docs).collect())))
    assert got == sorted(map(str, [(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 1, None), (5, 0, 5)]))
    assert jaccard_components(docs.limit(0)).count() == 0


def test_buckets_stream_over_any_batches():
    rng = np.random.default_rng(0)
    for _ in range(80):
        rows = sorted((int(t), int(i)) for t, i in zip(rng.integers(0, 6, 40), rng.integers(1, 12, 40), strict=True))
        cuts = sorted(rng.integers(0, 41, 6))
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in part], pa.int64()), pa.array([i for _, i in part], pa.int64()), pa.array([i for _, i in part], pa.int32()), pa.array([1] * len(part), pa.int8())],
                names=["token", "set_id", "n", "m"],
            )
            for part in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)) if part
        ]
        got = sorted((r["token"], r["set_id"], r["n"], r["hubs"]) for b in _buckets(3, 50)(iter(batches)) for r in b.to_pylist())
        groups: dict[int, set[int]] = {}
        for t, i in rows:
            groups.setdefault(t, set()).add(i)
        # the first three of a bucket are hubs of those after them that are at most twice as large
        want = [(t, i, i, [h for h in sorted(g)[:3] if h < i and 2 * h >= i]) for t, g in groups.items() if len(g) > 1 for i in g]
        assert got == sorted(want)
