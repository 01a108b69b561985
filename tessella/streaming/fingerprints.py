"""Incremental fingerprints: new documents of a folder are added to a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, size, hash) of files (path, text)."""
    return files.select("path", F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def follow(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files of ``folder`` as they come and keeps their fingerprints in ``target``.

    One run handles all that is there; the checkpoint makes sure that each file counts once."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return fingerprints(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
