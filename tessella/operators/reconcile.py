"""Reconciling a source tree with a destination: one state for each path.

Both sides: relative_path, size, hash. The reference order is by path components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.policy import PreflightRules, path_issues
from tessella.functions.text import normalize_key, path_key

STATES = ["verified", "partial", "missing", "moved", "conflict", "blocked", "destination_only"]


def roots_are_nested(a: str, b: str) -> bool:
    """Whether one absolute path is the other or lies in it."""
    x, y = ([p for p in s.split("/") if p] for s in (a, b))
    n = min(len(x), len(y))
    return x[:n] == y[:n]


def path_collisions(source: DataFrame) -> DataFrame:
    """(key, n) of keys that several source paths have."""
    return source.groupBy(normalize_key(F.col("relative_path")).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def plan(source: DataFrame, destination: DataFrame, rules: PreflightRules = PreflightRules()) -> DataFrame:
    """(relative_path, size, state, destination_relative, issues); a hash may be null where no file of
    the other side has the same size.

    Paths meet by normalised key; what has no partner meets by content hash. Of several destination
    files with one key, or one hash, the first by path counts."""
    first = lambda c: Window.partitionBy(c).orderBy(path_key(F.col("relative_path")))
    s = source.select("relative_path", "size", "hash").withColumn("key", normalize_key(F.col("relative_path")))
    s = s.join(s.groupBy("key").agg(F.count("*").alias("n")), "key")
    d = destination.select("relative_path", "size", "hash").withColumn("key", normalize_key(F.col("relative_path")))
    d = d.withColumn("r", F.row_number().over(first("key")))
    claimed = s.filter("n = 1").select("key")
    pairs = s.filter("n = 1").join(
        d.filter("r = 1").select("key", F.col("relative_path").alias("destination_relative"), F.col("size").alias("d_size"), F.col("hash").alias("d_hash")), "key", "left"
    )
    no_issue = F.array().cast("array<string>")
    met = pairs.filter(F.col("d_size").isNotNull()).select(
        "relative_path", "size",
        F.when(F.col("size") != F.col("d_size"), "partial").when(F.col("hash") == F.col("d_hash"), "verified").otherwise("conflict").alias("state"),
        "destination_relative", no_issue.alias("issues"), F.lit(None).cast("string").alias("taken"),
    )
    collided = s.filter("n > 1").select(
        "relative_path", "size", F.lit("blocked").alias("state"), F.lit(None).cast("string").alias("destination_relative"),
        F.array(F.lit("path_collision")).alias("issues"), F.lit(None).cast("string").alias("taken"),
    )
    lone = pairs.filter(F.col("d_size").isNull()).withColumn("issues", path_issues(F.col("relative_path"), F.col("size"), rules))
    matched_first = claimed.withColumn("r", F.lit(1))
    residue = d.join(matched_first, ["key", "r"], "left_anti")
    by_hash = residue.filter("hash IS NOT NULL").withColumn("h", F.row_number().over(first("hash"))).filter("h = 1").select(
        "hash", F.col("relative_path").alias("target"), F.col("key").alias("target_key")
    )
    ok = F.size("issues") == 0
    alone = lone.drop("destination_relative").join(by_hash, "hash", "left").select(
        "relative_path", "size",
        F.when(~ok, "blocked").when(F.col("target").isNotNull(), "moved").otherwise("missing").alias("state"),
        F.when(ok, F.col("target")).alias("destination_relative"), "issues", F.when(ok, F.col("target_key")).alias("taken"),
    )
    sources = met.unionByName(collided).unionByName(alone)
    # a key is claimed by a source at that path, or by a move to a file with it
    keys = claimed.join(d.select("key").distinct(), "key", "left_semi").unionByName(alone.filter("taken IS NOT NULL").select(F.col("taken").alias("key"))).distinct()
    rest = residue.join(keys, "key", "left_anti").select(
        "relative_path", "size", F.lit("destination_only").alias("state"), F.col("relative_path").alias("destination_relative"),
        no_issue.alias("issues"),
    )
    return sources.drop("taken").unionByName(rest)


def summary(planned: DataFrame) -> DataFrame:
    return planned.agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))


def transfer_summary(planned: DataFrame, copy_moved: bool = False) -> DataFrame:
    """What a run of the plan copies and skips."""
    copied = F.col("state").isin("missing", "partial", *(["moved"] if copy_moved else []))
    return planned.agg(
        F.count_if(copied).alias("copied"), F.coalesce(F.sum(F.when(copied, F.col("size"))), F.lit(0)).alias("bytes_copied"),
        F.count_if(F.col("state") == "verified").alias("skipped_verified"), F.count_if(F.col("state") == "conflict").alias("skipped_conflict"),
        F.count_if(F.col("state") == "blocked").alias("skipped_blocked"),
        F.count_if((F.col("state") == "moved") & F.lit(not copy_moved)).alias("skipped_moved"),
    )


def journal_entries(planned: DataFrame, run_id: int) -> DataFrame:
    """Plan rows as an append-only journal keeps them: state label, and details as JSON."""
    detail = F.when(F.col("state") == "moved", F.to_json(F.struct("destination_relative"))).when(F.col("state") == "blocked", F.to_json(F.struct("issues")))
    return planned.select(F.lit(run_id).cast("long").alias("run_id"), "relative_path", "size", "state", detail.alias("detail"))
