"""Listing folder trees, reading their files, and copying files with verification.

Spark's own file readers hide names that start with ``_`` or ``.``; the lister here doesn't. It walks on
the executors, one task for each folder below the roots."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.functions.text import is_ignored

BUFFER = 256 * 1024


class _Unit(InputPartition):
    def __init__(self, root: str, folder: str, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


class _TreeReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        units: list[InputPartition] = []
        for root in self.roots:
            if os.path.isdir(root):
                units.append(_Unit(root, root, False))
                units += [_Unit(root, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
        return units or [_Unit("", "", False)]

    def read(self, unit: _Unit) -> Iterator[tuple]:
        if not unit.root:
            return
        for folder, below, names in os.walk(unit.folder):
            if not unit.deep:
                below.clear()
            for name in names:
                path = os.path.join(folder, name)
                info = os.lstat(path)
                if os.path.isfile(path) and not os.path.islink(path):
                    yield unit.root, path, os.path.relpath(path, unit.root), info.st_size, info.st_mtime_ns // 1_000_000


class TreeSource(DataSource):
    """``spark.read.format("tree").option("roots", "a\\nb")``: regular files, links not followed; a
    missing root is empty."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "root string, path string, relative_path string, size long, mtime_ms long"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader([r for r in self.options["roots"].split("\n") if r])


def scan(spark: SparkSession, *roots: str) -> DataFrame:
    """Files of one or more trees without ignored names; overlapping roots give a file once."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format("tree").option("roots", "\n".join(os.path.abspath(r) for r in roots)).load()
    return found.filter(~is_ignored(F.col("path"))).dropDuplicates(["path"])


def with_content(files: DataFrame) -> DataFrame:
    """Adds ``content``; for files that fit a row. Unreadable ones have null and the reason in ``error``."""
    from pyspark.sql import types as T

    at = files.columns.index("path")

    def read(batches):
        for batch in batches:
            content, error = [], []
            for path in batch.column(at).to_pylist():
                try:
                    content.append(Path(path).read_bytes())
                    error.append(None)
                except OSError as e:
                    content.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary()), pa.array(error, pa.string())], names=[*batch.schema.names, "content", "error"])

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    return files.mapInArrow(read, schema)


def with_hash(files: DataFrame) -> DataFrame:
    """Adds ``hash``, the SHA-256 of each file, streamed by path so that size doesn't matter."""
    from pyspark.sql import types as T

    at = files.columns.index("path")

    def run(batches):
        for batch in batches:
            hashes = [file_hash(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], names=[*batch.schema.names, "hash"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("hash", T.StringType())]))


def file_hash(path: str) -> str | None:
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while part := f.read(BUFFER):
                digest.update(part)
    except OSError:
        return None
    return digest.hexdigest()


def copy_file(source: str, target: str, attempt: str) -> int:
    """Copies by way of a ``.part`` file of this attempt, reads it back, and renames it; returns bytes.

    A task that is run twice writes the same file twice, each by its own part."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part, digest, size = f"{target}.{attempt}.part", hashlib.sha256(), 0
    try:
        with open(source, "rb") as r, open(part, "wb") as w:
            while data := r.read(BUFFER):
                digest.update(data)
                w.write(data)
                size += len(data)
            w.flush()
            os.fsync(w.fileno())
        info = os.stat(source)
        os.utime(part, ns=(info.st_atime_ns, info.st_mtime_ns))
        if file_hash(part) != digest.hexdigest():
            raise OSError(f"{target} differs from its source after copying")
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return size


def discard_stale_parts(root: str) -> int:
    """Removes ``.part`` files an earlier run left below a destination."""
    stale = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(".part")]
    for path in stale:
        os.remove(path)
    return len(stale)


def transfer(planned: DataFrame, source_root: str, destination_root: str, copy_moved: bool = False) -> DataFrame:
    """Copies what a plan has as missing or partial (and moved, if asked) and reports
    (relative_path, outcome, bytes, detail). A failed file doesn't stop the others."""
    from pyspark import TaskContext

    states = ["missing", "partial", *(["moved"] if copy_moved else [])]

    def run(batches):
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        for batch in batches:
            rows = []
            for path, origin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, "copied", copy_file(os.path.join(source_root, origin), os.path.join(destination_root, path), attempt), None))
                except OSError as e:
                    rows.append((path, "failed", None, str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["relative_path", "outcome", "bytes", "detail"])

    # archived files are planned under another name than they have at the source
    origin = F.regexp_replace("relative_path", "^_collapsed/", "")
    todo = planned.filter(F.col("state").isin(states)).select("relative_path", origin.alias("origin"))
    return todo.mapInArrow(run, "relative_path string, outcome string, bytes long, detail string")
