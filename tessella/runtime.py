"""Session helpers: where cut lineage is written, and how tables are read."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that go to a Python worker at once; Spark's own default is ten times that.
TEXT_ROWS = 1000
#: Files a core for tables dealt by a shuffle: those with a few numbers a row, and those with arrays or
#: several rows a document. Bytes of their row groups, so that large files are still read in parts.
FEW, SOME, ROW_GROUP = 4, 8, 16 << 20


def session(master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{n}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package, also where the driver found it by
    ``sys.path`` alone. A cluster gets it with ``--py-files`` or on its workers' path."""
    if spark.sparkContext.master.startswith("local"):
        root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for cut lineage (``spark.checkpoint.dir``).

    Only a local master may go without the setting: driver and executors are one process
    there, so a temporary folder is shared by construction.
    """
    found = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT} to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set(_CHECKPOINT, made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, name: str = "step", per_core: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage with files any executor can read again after another is lost; the folder is
    deleted when the driver's JVM ends. With ``per_core`` the partitions are written one after the
    other into that many files a core at most. Without Hadoop's native library an executor starts two
    processes for each file on a local disk, each of which shares all of the JVM's memory at first.
    """
    spark = df.sparkSession
    if per_core:
        df = df.coalesce(per_core * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    writer = df.write.option("parquet.block.size", ROW_GROUP) if per_core else df.write
    writer.parquet(path)
    target.getFileSystem(conf).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def lean(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends at most ``TEXT_ROWS`` rows at once to a Python worker, so that
    the JVM's and the worker's copies of a batch of whole texts stay small. Applies to what is run from
    then on; a smaller setting of the user's stays."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) > TEXT_ROWS or int(conf.get(_BATCH)) <= 0:
        conf.set(_BATCH, str(TEXT_ROWS))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, also those whose names have dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; ``sf_dir`` may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
