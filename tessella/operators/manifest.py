"""Manifests: a recorded snapshot of files against the current one, and the vote on its integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import path_key
from tessella.runtime import materialize


#: The folder of a manifest's own files.
FOLDER = ".tessella"


def is_artifact(path: Column) -> Column:
    """Files that the manifest itself is made of."""
    return path.startswith(FOLDER + "/") | path.isin("manifest.json", "manifest.json.sha256")


def file_records(files: DataFrame) -> DataFrame:
    """(relative_path, sha256, size) of files (path, size, content)."""
    return files.filter(~is_artifact(F.col("path"))).select(F.col("path").alias("relative_path"), F.sha2(F.col("content"), 256).alias("sha256"), "size")


def duplicate_groups(records: DataFrame) -> DataFrame:
    """(sha256, size, n_files, first_path) of contents that several files have; ``duplicate_paths`` has all paths."""
    return (
        records.groupBy("sha256").agg(F.first("size").alias("size"), F.count("*").alias("n_files"), F.min("relative_path").alias("first_path"))
        .filter("n_files > 1")
    )


def duplicate_paths(records: DataFrame) -> DataFrame:
    """(sha256, size, relative_path) of every member of a group, a row each, as groups have no bound."""
    return records.join(duplicate_groups(records).select("sha256"), "sha256", "left_semi").select("sha256", "size", "relative_path")


def named_families(ranked: DataFrame) -> DataFrame:
    """(family_id, rank, path): families are numbered by falling size, then by their least path."""
    sizes = ranked.groupBy("family").agg(F.count("*").alias("n"))
    # numbers run over all families: ordered by ranges, each task counts on from what lies before it
    dealt = sizes.repartitionByRange(F.desc("n"), "family").sortWithinPartitions(F.desc("n"), "family").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "families")
    own = Window.partitionBy("part").orderBy(F.desc("n"), "family")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = dealt.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    numbered = dealt.join(F.broadcast(starts), "part").select("family", F.format_string("f_%05d", F.col("start") + F.row_number().over(own) - 1).alias("family_id"))
    return ranked.join(numbered, "family").select("family_id", "rank", "path")


def verify_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, status, current_path): unchanged, changed, moved, deleted and unrecorded files."""
    now = current.select("relative_path", F.col("sha256").alias("now"))
    by_hash = current.groupBy("sha256").agg(F.min_by("relative_path", path_key(F.col("relative_path"))).alias("other_path"))
    rows = recorded.join(now, "relative_path", "left").join(by_hash, "sha256", "left")
    status = (
        F.when(F.col("now") == F.col("sha256"), "unchanged").when(F.col("now").isNotNull(), "changed")
        .when(F.col("other_path").isNotNull(), "moved").otherwise("deleted")
    )
    rows = rows.withColumn("status", status).withColumn(
        "current_path", F.when(F.col("now").isNotNull(), F.col("relative_path")).otherwise(F.col("other_path"))
    )
    claimed = rows.filter("current_path IS NOT NULL").select(F.col("current_path").alias("relative_path")).distinct()
    fresh = current.join(claimed, "relative_path", "left_anti").select("relative_path", F.lit("unrecorded").alias("status"), F.col("relative_path").alias("current_path"))
    return rows.select("relative_path", "status", "current_path").unionByName(fresh)


def majority(*hashes: Column) -> Column:
    """Whether at least two of the hashes are there and equal."""
    pairs = [hashes[i] == hashes[j] for i in range(len(hashes)) for j in range(i)]
    return F.greatest(*(F.coalesce(p, F.lit(False)) for p in pairs))
