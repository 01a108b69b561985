from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import similarity, versions
from tests.test_family_scale import plain_families, ranked_rows


def texts_of(rng):
    words = [f"w{k}" for k in range(2000)]
    out = {}
    for g in range(4):
        base = rng.choices(words, k=120)
        for k in range(9):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out[f"g{g}/{k}.txt"] = " ".join(t + (rng.choices(words, k=70) if k % 4 == 3 else []))
    return out | {"z/long.txt": " ".join(rng.choices(words, k=900)), "z/short.txt": "Ärger İstanbul ΣΑΣ", "z/none.txt": "..."}


def test_pairs_by_blocks_and_links(spark):
    rows = texts_of(random.Random(3))
    docs = spark.createDataFrame(list(rows.items()), "path string, text string")
    ready = similarity.signatures(docs)
    got = {r["path"]: r for r in ready.collect()}
    want = {r["path"]: r["t"] for r in docs.select("path", T.shingle_tokens(F.col("text")).alias("t")).collect() if r["t"]}
    assert {p: set(r["tokens"]) for p, r in got.items()} == {p: set(t) for p, t in want.items()}
    comp = {r["path"]: r["component"] for r in similarity.candidate_components(ready).collect()}
    expected = {}
    for a, b in combinations(sorted(comp, key=lambda p: p.split("/")), 2):
        j = sum(x == y for x, y in zip(got[a]["sig"], got[b]["sig"], strict=True)) / 128
        if comp[a] == comp[b] and j >= 0.5:
            shared = len(set(want[a]) & set(want[b]))
            expected[a, b] = (j, shared / len(want[a]), shared / len(want[b]))
    assert len(expected) > 50
    rows = similarity.similar_pairs(docs, block=4).collect()
    assert len(rows) == len(expected)
    assert {(r["a"], r["b"]): (r["jaccard"], r["a_to_b"], r["b_to_a"]) for r in rows} == expected
    links = similarity.similar_pairs(docs, links=True).collect()
    assert len(links) < len(expected) / 2
    files = spark.createDataFrame([(p, 0) for p in comp], "path string, mtime_ms long")
    found = versions.families(spark.createDataFrame(links), files)
    assert ranked_rows(found) == plain_families([(r["a"], r["b"], r["relationship"]) for r in rows])


def test_signature_where_hashes_meet_the_ends():
    """Tokens whose hashes are 0, near 0, near the prime, and closer to each other than the fractions are exact."""
    p = similarity.PRIME
    pairs = np.array(similarity.coefficients(11, 24), np.uint64)
    tokens = [(h - b) * pow(a, -1, p) % p for a, b in pairs.tolist() for h in (0, 1, 2, (1 << 28) + 1, p - 1, p - (1 << 29))]
    for some in (tokens, tokens[3::6], tokens[4::6], tokens[5::6] * 2, tokens[:1], tokens * 9):
        assert similarity.signature(np.array(some, np.int64), pairs).tolist() == [min((a * t + b) % p for t in some) for a, b in pairs.tolist()]


def test_signatures_go_to_python_a_few_rows_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        tokens = spark.createDataFrame([("a", [1, 2, 3])], "path string, tokens array<long>")
        similarity.signed(tokens).collect()
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
