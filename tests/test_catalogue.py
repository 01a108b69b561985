from __future__ import annotations

import hashlib
import random
import re

from tessella.operators import reconcile
from tessella.plans import catalogue


def shingles(text: str) -> set[str]:
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    return {hashlib.md5(" ".join(words[k : k + 5]).encode()).hexdigest()[:15] for k in range(max(len(words) - 4, 1))} if words else set()


def test_coverage_pairs_reach_ids_beyond_400(spark, tmp_path):
    rng = random.Random(5)
    texts = {k: " ".join(rng.choices("abc", k=rng.randint(0, 14))) for k in [*range(6), *range(397, 404), 9_998, 9_999, 10**12, 10**12 + 1]}
    rows = [(k, t, "en", "s") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for k in texts:
        if k + 1 in texts:
            a, b = shingles(texts[k]), shingles(texts[k + 1])
            want[k, k + 1] = (len(a & b) / len(a) if a else 0.0, 2 * len(a & b) / (len(a) + len(b)) if a or b else None)
    got = {(r["a"], r["b"]): (r["a_to_b"], r["dice"]) for r in catalogue.coverage_pairs(spark, str(tmp_path)).collect()}
    assert got == want
    assert {(400, 401), (9_998, 9_999), (10**12, 10**12 + 1)} <= set(got)


def test_path_collisions_compare_whole_paths(spark):
    long = "root/" + "folder/" * 40
    paths = [long + "A.txt", long + "a.TXT", long + "b.txt", long + "b.txt2"]
    got = reconcile.path_collisions(spark.createDataFrame([(p,) for p in paths], "relative_path string")).collect()
    assert [(r["key"], r["n"]) for r in got] == [(long + "a.txt", 2)]
