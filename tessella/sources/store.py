"""Tables that outlive a run: the fingerprint cache and the journal of plans and transfers.

Each is a folder of Parquet tables that any Spark file system can hold. The cache is written beside the
old one and then takes its place; the journal only grows."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.reconcile import journal_entries

CACHE = "path string, size long, mtime_ms long, sample_hash string, full_hash string"
JOURNAL = {
    "plan_runs": "run_id long, source_root string, destination_root string, created_unix_ms long",
    "plan_entries": "run_id long, relative_path string, size long, state string, detail string",
    "transfer_events": "run_id long, relative_path string, outcome string, bytes long, detail string, created_unix_ms long",
}


def _path(spark: SparkSession, name: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(name)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def load_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache; an empty one where there is none or it can't be read."""
    empty = spark.createDataFrame([], CACHE)
    try:
        found = spark.read.parquet(folder)
        return found.select(*(F.col(f.name).cast(f.dataType) for f in empty.schema)) if set(empty.columns) <= set(found.columns) else empty
    except AnalysisException:
        return empty


def save_cache(cache: DataFrame, folder: str) -> None:
    """Writes ``cache`` whole before it replaces what is there; paths that aren't text are left out."""
    spark = cache.sparkSession
    fresh = f"{folder.rstrip('/')}.{time.time_ns()}"
    cache.filter(~F.contains("path", F.lit("�"))).write.parquet(fresh)
    fs, target = _path(spark, folder)
    fs.delete(target, True)
    if not fs.rename(_path(spark, fresh)[1], target):
        raise OSError(f"{folder} could not be replaced")


def journal_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the journal; empty before its first row."""
    fs, path = _path(spark, f"{folder.rstrip('/')}/{name}")
    return spark.read.schema(JOURNAL[name]).parquet(path.toString()) if fs.exists(path) else spark.createDataFrame([], JOURNAL[name])


def latest_run(runs: DataFrame) -> DataFrame:
    """(run_id) of the last run; null if there is none."""
    return runs.agg(F.max("run_id").alias("run_id"))


def counts(runs: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, n_entries, n_events) of every run."""
    n = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    both = runs.select("run_id").join(n(entries, "n_entries"), "run_id", "left").join(n(events, "n_events"), "run_id", "left")
    return both.fillna(0, ["n_entries", "n_events"])


def record_plan(spark: SparkSession, folder: str, planned: DataFrame, source: str, destination: str) -> int:
    """Adds a run and its entries; returns its id. The run is written last, so that it stands for whole entries."""
    run_id = (latest_run(journal_table(spark, folder, "plan_runs")).first()["run_id"] or 0) + 1
    journal_entries(planned, run_id).write.mode("append").parquet(f"{folder}/plan_entries")
    run = [(run_id, source, destination, int(time.time() * 1000))]
    spark.createDataFrame(run, JOURNAL["plan_runs"]).coalesce(1).write.mode("append").parquet(f"{folder}/plan_runs")
    return run_id


def record_transfers(done: DataFrame, folder: str, run_id: int) -> None:
    """Adds what became of each file of a run, from (relative_path, outcome, bytes, detail)."""
    rows = done.select(F.lit(run_id).cast("long").alias("run_id"), "relative_path", "outcome", "bytes", "detail", F.unix_millis(F.current_timestamp()).alias("created_unix_ms"))
    rows.write.mode("append").parquet(f"{folder}/transfer_events")
