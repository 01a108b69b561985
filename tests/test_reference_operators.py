from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, policy
from tessella.functions import text as T
from tessella.operators import duplicates, manifest, reconcile, similarity, versions
from tessella.sources import files as S


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_paths_and_kinds(spark):
    got = column(spark, ["a/b.TXT", "a/.bashrc", "x.tar.gz", "noext", "a.b/c", "p.py", "~$x.docx"]).select(T.extension(F.col("x")), T.kind(F.col("x")), T.is_ignored(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("txt", "plain_text", False), (None, None, False), ("gz", None, False), (None, None, False), (None, None, False), ("py", "source_code", False), ("docx", "docx", True)]
    assert [r[0] for r in column(spark, ["A\\B", "é", "É"]).select(T.normalize_key(F.col("x"))).collect()] == ["a/b", "é", "é"]


def test_shingles_and_measures(spark):
    words = lambda p, n: [f"{p}{k}" for k in range(n)]
    core, more = words("core", 30), words("extra", 12)
    df = spark.createDataFrame([(" ".join(core), " ".join(core + more))], "a string, b string").select(T.shingle_tokens(F.col("a")).alias("a"), T.shingle_tokens(F.col("b")).alias("b"))
    row = df.select(T.coverage(F.col("a"), F.col("b")), T.coverage(F.col("b"), F.col("a")), T.dice(F.col("a"), F.array().cast("array<bigint>"))).first()
    assert row[0] == 1.0 and row[1] == pytest.approx(26 / 38) and row[2] == 0.0
    sizes = column(spark, ["", "one two", "a b c d e", "a b c d e f", "!!"]).select(F.size(T.shingle_tokens(F.col("x")))).collect()
    assert [r[0] for r in sizes] == [0, 1, 1, 2, 0]


def test_minhash_equals_plain_integers():
    pairs = np.array(similarity.coefficients(7, 16), np.uint64)
    rng = random.Random(1)
    tokens = [rng.randrange(1 << 60) for _ in range(50)]
    want = [min((int(a) * t + int(b)) % similarity.PRIME for t in tokens) for a, b in pairs]
    assert similarity.signature(np.array(tokens, np.int64), pairs).tolist() == want


def test_policy(spark):
    paths = ["ok/file.txt", "a/CON.txt", "b:c?d:", "dir./x", "e ", "x" * 300, "lpt1"]
    got = [r[0] for r in column(spark, paths).select(policy.path_issues(F.col("x"))).collect()]
    assert got == [[], ["reserved_name:CON.txt"], ["illegal_character::", "illegal_character:?"], ["trailing_dot_or_space:dir."], ["trailing_dot_or_space:e "], ["path_too_long"], ["reserved_name:lpt1"]]
    rules = policy.PreflightRules(fat32_limit=10)
    assert column(spark, ["a"]).select(policy.path_issues(F.col("x"), F.lit(11), rules)).first()[0] == ["file_too_large"]


def test_dates(spark):
    mails = {"Mon, 01 Feb 2021 10:20:07 +0130": 1612169407000, "1 Jan 70 00:00 GMT": 0, "2 Jan 69 00:00:00 -0000": 3124310400000, "nonsense": None, "1 Foo 2020 00:00": None}
    assert [r[0] for r in column(spark, list(mails)).select(dates.rfc5322_millis(F.col("x"))).collect()] == list(mails.values())
    office = {"1970-01-02": 86400000, "2024-03-01T04:05:06Z": 1709265906000, "2024-03-01T04:05:06.75Z": 1709265900000, "2024-03-01T04:05:06+01:00": 1709262306000, "x": None}
    assert [r[0] for r in column(spark, list(office)).select(dates.w3cdtf_millis(F.col("x"))).collect()] == list(office.values())


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, relationship string")


def test_version_chain_and_cycle(spark):
    files = spark.createDataFrame([(p, k, k) for k, p in enumerate("abcdxyz")], "path string, mtime_ms long, size long")
    chain = pairs_of(spark, [("a", "b", "b_is_more_complete"), ("b", "c", "b_is_more_complete"), ("x", "y", "near_duplicate"), ("d", "z", "diverged")])
    got = {r["path"]: (r["rank"], r["completeness"], r["is_tip"]) for r in versions.families(chain, files).collect()}
    assert got == {"c": (1, 2, True), "b": (2, 1, False), "a": (3, 0, False), "y": (1, 2, False), "x": (2, 2, False)}
    assert versions.flagged(chain).count() == 1
    sane = {r["path"]: r["completeness"] for r in versions.families(chain, files, count_self=False).collect()}
    assert sane["x"] == sane["y"] == 1
    with pytest.raises(ValueError):
        versions.CollapseConfig(keep_newest=0)


def test_duplicates_and_cache(spark):
    rows = [("r/a", b"same", 1), ("r/b", b"same", 2), ("r/c", b"diff", 3), ("r/e1", b"", 4), ("r/e2", b"", 5), ("r/a.txt", b"same", 6)]
    files = spark.createDataFrame([(p, len(c), c, t) for p, c, t in rows], "path string, size long, content binary, mtime_ms long")
    got = {r["first_path"]: (r["n_files"], r["reclaimable"]) for r in duplicates.duplicate_groups(files).collect()}
    assert got == {"r/a": (3, 8), "r/e1": (2, 0)}
    big = bytes(200_000)
    other = big[:100_000] + b"x" + big[100_001:]
    two = spark.createDataFrame([("a", len(big), big), ("b", len(other), other)], "path string, size long, content binary")
    assert duplicates.sample_survivors(two).count() == 2 and duplicates.duplicate_groups(two).count() == 0


def test_reconcile_states(spark):
    schema = "relative_path string, size long, hash string"
    source = [("same", 1, "h1"), ("part", 2, "h2"), ("conf", 3, "h3"), ("gone", 4, "h4"), ("was/here", 5, "h5"), ("X", 6, "h6"), ("x", 6, "h7"), ("a?b", 1, "h8")]
    dest = [("SAME", 1, "h1"), ("part", 1, "h2"), ("conf", 3, "hx"), ("now/there", 5, "h5"), ("other", 9, "h9")]
    got = {r["relative_path"]: r["state"] for r in reconcile.plan(spark.createDataFrame(source, schema), spark.createDataFrame(dest, schema)).collect()}
    assert got == {"same": "verified", "part": "partial", "conf": "conflict", "gone": "missing", "was/here": "moved", "X": "blocked", "x": "blocked", "a?b": "blocked", "other": "destination_only"}
    assert reconcile.roots_are_nested("/a/b", "/a/b/c") and not reconcile.roots_are_nested("/a/b", "/a/bc")


def test_manifest_diff_and_vote(spark):
    schema = "relative_path string, sha256 string"
    then = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], schema)
    now = spark.createDataFrame([("a", "1"), ("b", "x"), ("c2", "3"), ("e", "5")], schema)
    assert {r[0]: r[1] for r in manifest.verify_diff(then, now).collect()} == {"a": "unchanged", "b": "changed", "c": "moved", "d": "deleted", "e": "unrecorded"}
    votes = spark.createDataFrame([("x", "x", None), ("x", None, None), ("x", "y", "z"), ("x", "y", "y")], "a string, b string, c string")
    assert [r[0] for r in votes.select(manifest.majority(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False, True]


def test_scan_plan_copy_and_plan_again(spark, tmp_path):
    source, dest = tmp_path / "s", tmp_path / "d"
    for name, data in {"a.txt": b"one", "sub/_b": b"two", "sub/.hidden": b"three", ".DS_Store": b"junk", "sub/deep/c": b"one"}.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(data)
    dest.mkdir()
    (dest / "a.txt").write_bytes(b"on")
    (dest / "old.part").write_bytes(b"")

    def planned():
        side = lambda root: S.with_hash(S.scan(spark, str(root))).select("relative_path", "size", "hash")
        return reconcile.plan(side(source), side(dest))

    assert S.discard_stale_parts(str(dest)) == 1
    assert {r["relative_path"]: r["state"] for r in planned().collect()} == {"a.txt": "partial", "sub/_b": "missing", "sub/.hidden": "missing", "sub/deep/c": "missing"}
    done = S.transfer(planned(), str(source), str(dest)).collect()
    assert {r["outcome"] for r in done} == {"copied"} and (dest / "sub/deep/c").read_bytes() == b"one"
    assert os.stat(dest / "a.txt").st_mtime_ns == os.stat(source / "a.txt").st_mtime_ns
    assert {r["state"] for r in planned().collect()} == {"verified"}
    both = S.scan(spark, str(source), str(source / "sub"))
    assert both.count() == 4 and S.with_content(both).filter("content IS NULL").count() == 0
    assert S.scan(spark, str(tmp_path / "none")).count() == 0
