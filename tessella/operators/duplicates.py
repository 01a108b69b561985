"""Exact duplicates of a table of files: a cascade of size, sample hash and full hash.

``files``: path, size, content (or any column the hashes are taken of)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import path_key

SAMPLE = 64 * 1024


def sample_hash(content: Column, size: Column) -> Column:
    """Hash of the first 64 KiB, and of the last 64 KiB of files over 128 KiB."""
    tail = F.when(size > 2 * SAMPLE, F.substring(content, -SAMPLE, SAMPLE)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.substring(content, 1, SAMPLE), tail), 256)


def size_groups(files: DataFrame) -> DataFrame:
    return files.groupBy("size").agg(F.count("*").alias("n_files")).filter("n_files > 1")


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, size, sample, hash) of files, taken where they are read: contents are never shuffled."""
    return files.select("path", "size", sample_hash(F.col("content"), F.col("size")).alias("sample"), F.sha2(F.col("content"), 256).alias("hash"))


def sample_survivors(files: DataFrame) -> DataFrame:
    """Fingerprints of files that share size and sample hash with another.

    Candidates come by joins with aggregated groups, so no group is gathered in a window."""
    prints = fingerprints(files)
    repeated = prints.groupBy("size", "sample").agg(F.count("*").alias("n")).filter("n > 1").select("size", "sample")
    return prints.join(repeated, ["size", "sample"], "left_semi").select("path", "size", "sample", "hash")


def hashed(files: DataFrame) -> DataFrame:
    """(path, size, hash) of files that may have a copy; of files with a ``hash`` already, those that share it."""
    if "hash" in files.columns:
        return files.select("path", "size", "hash")
    return sample_survivors(files).select("path", "size", "hash")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(hash, size, n_files, first_path, reclaimable) of files with equal contents."""
    return (
        hashed(files).groupBy("hash", "size")
        .agg(F.count("*").alias("n_files"), F.min_by("path", path_key(F.col("path"))).alias("first_path"))
        .filter("n_files > 1").withColumn("reclaimable", F.col("size") * (F.col("n_files") - 1))
    )


def duplicate_members(files: DataFrame) -> DataFrame:
    """(path, size, hash, first_path) of every member of a group."""
    groups = duplicate_groups(files).select("hash", "first_path")
    return hashed(files).join(groups, "hash").select("path", "size", "hash", "first_path")


def representatives(files: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Files without the members of duplicate groups that aren't their first by path; ``hashes`` (path, size, hash)
    if they are known."""
    later = duplicate_members(files if hashes is None else hashes).filter("path != first_path").select("path")
    return files.join(later, "path", "left_anti")


def analyze_report(files: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Totals of files, and of the groups of those that have a copy; ``hashes`` (path, size, hash) if known."""
    totals = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    found = duplicate_groups(files if hashes is None else hashes).agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable")
    )
    return totals.join(found)


def cache_lookup(files: DataFrame, cache: DataFrame, tolerance_ms: int = 2000) -> DataFrame:
    """Files with the full hash of a cache (path, size, mtime_ms, full_hash) where size is equal and
    times differ by at most the tolerance."""
    c = cache.select("path", F.col("size").alias("c_size"), F.col("mtime_ms").alias("c_mtime"), "full_hash")
    fits = (F.col("size") == F.col("c_size")) & (F.abs(F.col("mtime_ms") - F.col("c_mtime")) <= tolerance_ms)
    return files.join(c, "path", "left").withColumn("full_hash", F.when(fits, F.col("full_hash"))).drop("c_size", "c_mtime")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """New cache from (path, size, mtime_ms, sample_hash, full_hash): a hash that ``fresh`` lacks is
    kept if size and time are unchanged."""
    o = cache.select("path", *(F.col(c).alias(f"o_{c}") for c in ("size", "mtime_ms", "sample_hash", "full_hash")))
    both = o.join(fresh, "path", "full_outer")
    same = (F.col("size") == F.col("o_size")) & (F.col("mtime_ms") == F.col("o_mtime_ms"))
    keep = lambda c: F.when(F.col("size").isNull(), F.col(f"o_{c}")).otherwise(F.coalesce(c, F.when(same, F.col(f"o_{c}"))))
    return both.select("path", F.coalesce("size", "o_size").alias("size"), F.coalesce("mtime_ms", "o_mtime_ms").alias("mtime_ms"), keep("sample_hash").alias("sample_hash"), keep("full_hash").alias("full_hash"))


def first_of(files: DataFrame, *by: str) -> DataFrame:
    """The first file by path of each key."""
    w = Window.partitionBy(*by).orderBy(path_key(F.col("path")))
    return files.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
