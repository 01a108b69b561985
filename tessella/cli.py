"""Command line: analyze, plan, run, similar, write-manifest and verify over folder trees."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import dates, formats
from tessella.functions.policy import PreflightRules
from tessella.functions.text import extension, kind
from tessella.operators import duplicates, manifest, reconcile, similarity, versions
from tessella.runtime import materialize, session
from tessella.sources import files as S
from tessella.sources import store

MANIFEST, BACKUP, CHECKSUM = "manifest.json", f"{manifest.FOLDER}/manifest.backup.json", "manifest.json.sha256"
WARNING = "Generated file. It is checksummed, and any change to it will be reported."


def format_bytes(n: int) -> str:
    """``1536`` as ``1.50 KiB``."""
    units, value = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"], float(n)
    k = 0
    while value >= 1024 and k < len(units) - 1:
        value, k = value / 1024, k + 1
    return f"{value:.2f} {units[k]}" if k else f"{n} B"


def _warn(what: str, error: Exception) -> None:
    print(f"warning: {what}: {error}", file=sys.stderr)


def _hashes(spark: SparkSession, files: DataFrame, cache: str | None) -> DataFrame:
    """``files`` with ``hash``, from the cache where it has one. What goes wrong with the cache is a warning."""
    if not cache:
        return S.with_hash(files)
    known = store.load_cache(spark, cache)
    looked = duplicates.cache_lookup(files, known).withColumnRenamed("full_hash", "hash")
    rows = materialize(looked.filter("hash IS NOT NULL").unionByName(S.with_hash(looked.filter("hash IS NULL").drop("hash"))), "hashes")
    fresh = rows.select("path", "size", "mtime_ms", F.lit(None).cast("string").alias("sample_hash"), F.col("hash").alias("full_hash"))
    try:
        store.save_cache(duplicates.cache_upsert(known, fresh), cache)
    except Exception as e:  # noqa: BLE001  any failure to save: results don't depend on it
        _warn("the cache was not saved", e)
    return rows


def _tree(spark: SparkSession, root: str) -> DataFrame:
    found = S.scan(spark, root).select("relative_path", "path", "size", "mtime_ms")
    return found.filter(~manifest.is_artifact(F.col("relative_path")))


def _copies(spark: SparkSession, files: DataFrame, cache: str | None = None) -> DataFrame:
    """(path, size, hash) of files that share their size with another: no others are read."""
    shared = files.join(duplicates.size_groups(files).select("size"), "size", "left_semi").select("path", "size", "mtime_ms")
    return materialize(_hashes(spark, shared, cache).filter("hash IS NOT NULL").select("path", "size", "hash"), "copies")


def _extracted(files: DataFrame, extensions: str | None = None) -> DataFrame:
    """(path, tokens, media, skip_reason) of files by their formats; only files of a known kind are read."""
    rows = files.select("path", "size", kind(F.col("path")).alias("kind"))
    if extensions is not None:
        wanted = [e.strip().removeprefix(".").lower() for e in extensions.split(",") if e.strip()]
        rows = rows.filter(F.coalesce(extension(F.col("path")).isin(wanted), F.lit(False)))
    known = S.with_content(rows.filter("kind IS NOT NULL").select("path", "kind"))
    unknown = rows.filter("kind IS NULL").select("path", F.array().cast("array<long>").alias("tokens"), F.array().cast("array<string>").alias("media"), F.lit("unsupported").alias("skip_reason"))
    return materialize(formats.extracted(known).unionByName(unknown), "extracted")


def _dated(files: DataFrame) -> DataFrame:
    """``files`` with ``mtime_ms`` by the dates that files state, where they do."""
    stating = files.select("path", extension(F.col("path")).alias("extension")).filter(F.col("extension").isin("docx", "pptx", "xlsx", "jpg", "jpeg", "tiff", "eml"))
    stated = formats.stated_dates(S.with_content(stating))
    rows = files.join(stated, "path", "left")
    millis, _ = dates.best_date(F.col("raw"), F.col("source"), F.col("mtime_ms"))
    return rows.withColumn("mtime_ms", millis).select(*files.columns)


def _similar(spark: SparkSession, roots: list[str], config: similarity.SimilarityConfig, extensions: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, their files, what was extracted) without copies of other files."""
    files = materialize(S.scan(spark, *roots).select("path", "size", "mtime_ms"), "files")
    hashes = _copies(spark, files)
    first = files.join(duplicates.duplicate_members(hashes).filter("path != first_path").select("path"), "path", "left_anti")
    found = _extracted(first, extensions)
    pairs = similarity.with_media(similarity.similar_pairs(found.select("path", "tokens"), config), found.select("path", "media"))
    return materialize(pairs, "pairs"), files, found


def analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = S.scan(spark, *a.roots).select("path", "size", "mtime_ms")
    return duplicates.analyze_report(found, _copies(spark, found, a.cache)).first().asDict()


def _plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    source, destination = os.path.abspath(a.source), os.path.abspath(a.destination)
    if reconcile.roots_are_nested(source, destination):
        raise SystemExit("one root lies in the other")
    rules = PreflightRules(a.max_path_length, 4_294_967_295 if a.fat32 else None)
    sides = [materialize(_tree(spark, root), "tree") for root in (source, destination)]

    def shared(own: DataFrame, other: DataFrame) -> DataFrame:
        """Files of a size that the other side has too; only these can be equal to one of its files."""
        return own.join(other.select("size").distinct(), "size", "left_semi").select("path", "size", "mtime_ms")

    both = shared(*sides).unionByName(shared(*sides[::-1]))
    hashes = materialize(_hashes(spark, both, a.cache).select("path", "hash"), "hashes")
    s, d = (t.join(hashes, "path", "left") for t in sides)
    # the plan is fixed before anything changes on disk
    return materialize(reconcile.plan(s, d, rules), "plan")


def _recorded(spark: SparkSession, planned: DataFrame, a: argparse.Namespace) -> int | None:
    try:
        return store.record_plan(spark, a.journal, planned, os.path.abspath(a.source), os.path.abspath(a.destination)) if a.journal else None
    except Exception as e:  # noqa: BLE001  a journal that fails doesn't stop a run
        return _warn("the plan was not recorded", e)


def plan(spark: SparkSession, a: argparse.Namespace) -> dict:
    planned = _plan(spark, a)
    _recorded(spark, planned, a)
    return reconcile.summary(planned).first().asDict()


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    planned = _plan(spark, a)
    run_id = _recorded(spark, planned, a)
    if a.mode == "collapse":
        pairs, f, _ = _similar(spark, [a.source], similarity.SimilarityConfig())
        config = versions.CollapseConfig(a.keep_newest, a.archive, tuple(x for x in a.protected_extensions.split(",") if x))
        decided = versions.collapse_decisions(f, versions.families(pairs, _dated(f)), config, _copies(spark, f))
        prefix = os.path.abspath(a.source) + "/"
        planned = materialize(versions.apply_collapse(planned, decided.withColumn("path", F.replace("path", F.lit(prefix), F.lit("")))), "plan")
    if a.dry_run:
        return reconcile.transfer_summary(planned, a.on_moved == "copy").first().asDict()
    S.discard_stale_parts(a.destination)
    # copies are made once, and counted from what was written down about them
    outcomes = materialize(S.transfer(planned, a.source, a.destination, a.on_moved == "copy"), "outcomes")
    if run_id is not None:
        try:
            store.record_transfers(outcomes, a.journal, run_id)
        except Exception as e:  # noqa: BLE001  the copies are made already
            _warn("the transfers were not recorded", e)
    done = outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return {r["outcome"]: {"files": r["n"], "bytes": r["bytes"]} for r in done.collect()}


def similar(spark: SparkSession, a: argparse.Namespace) -> dict:
    config = similarity.SimilarityConfig(cutoff=a.duplicate_cutoff, high_coverage=a.high_coverage)
    pairs, _, found = _similar(spark, a.roots, config, a.ext)
    skipped = {r["why"]: r["n"] for r in found.filter("skip_reason IS NOT NULL").groupBy(F.substring_index("skip_reason", ":", 1).alias("why")).agg(F.count("*").alias("n")).collect()}
    rows = pairs.orderBy(F.desc("jaccard"), "a", "b").toLocalIterator()
    return {"files_considered": found.filter("skip_reason IS NULL").count(), "files_skipped": skipped, "pairs": [r.asDict() for r in rows]}


def _local_hash_file(destination: str) -> str:
    base = os.environ.get("XDG_DATA_HOME", os.path.expanduser("~/.local/share"))
    return os.path.join(base, "tessella", hashlib.sha256(os.path.abspath(destination).encode()).hexdigest())


def _digest(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return hashlib.sha256(json.dumps(json.load(f), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    except (OSError, ValueError):
        return None


def write_manifest(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Writes the manifest, its backup, checksum and the hash kept elsewhere. Tables of the files, of all
    duplicates' paths and of version families are Parquet beside them, as they have no bound."""
    root = os.path.abspath(a.destination)
    records = S.with_hash(_tree(spark, root)).select("relative_path", F.col("hash").alias("sha256"), "size", "mtime_ms")
    folder = os.path.join(root, manifest.FOLDER)
    os.makedirs(folder, exist_ok=True)
    records = materialize(records, "records")
    records.write.mode("overwrite").parquet(os.path.join(folder, "files"))
    manifest.duplicate_paths(records).orderBy(F.desc("size"), "sha256", "relative_path").write.mode("overwrite").parquet(os.path.join(folder, "duplicates"))
    pairs, files, _ = _similar(spark, [root], similarity.SimilarityConfig())
    ranked = manifest.named_families(versions.families(pairs, _dated(files))).withColumn("path", F.replace("path", F.lit(root + "/"), F.lit("")))
    ranked.withColumn("status", F.lit("kept")).orderBy("family_id", "rank").write.mode("overwrite").parquet(os.path.join(folder, "families"))
    totals = records.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")).first().asDict()
    totals["duplicate_group_count"] = manifest.duplicate_groups(records).count()
    document = {
        "_warning": WARNING, "format_version": 1, "created_unix_ms": int(time.time() * 1000), "source_root": a.source and os.path.abspath(a.source),
        "destination_root": root, "summary": totals,
    }
    text = json.dumps(document, indent=2)
    for name, content in ((MANIFEST, text), (BACKUP, text), (CHECKSUM, hashlib.sha256(text.encode()).hexdigest() + f"  {MANIFEST}\n")):
        path = os.path.join(root, name)
        if os.path.exists(path):
            os.chmod(path, 0o644)
        with open(path, "w", encoding="utf-8") as f:
            f.write(content)
        os.chmod(path, 0o444)
    kept = _local_hash_file(root)
    os.makedirs(os.path.dirname(kept), exist_ok=True)
    with open(kept, "w", encoding="utf-8") as f:
        f.write(_digest(os.path.join(root, MANIFEST)) or "")
    return document


def verify(spark: SparkSession, a: argparse.Namespace) -> dict:
    try:
        with open(_local_hash_file(a.destination), encoding="utf-8") as f:
            elsewhere = f.read() or None
    except OSError:
        elsewhere = None
    votes = [v for v in (_digest(os.path.join(a.destination, MANIFEST)), _digest(os.path.join(a.destination, BACKUP)), elsewhere) if v]
    table = os.path.join(os.path.abspath(a.destination), manifest.FOLDER, "files")
    if not os.path.isdir(table):
        raise SystemExit(f"no manifest in {a.destination}")
    then = spark.read.parquet(table)
    now = S.with_hash(_tree(spark, a.destination)).select("relative_path", F.col("hash").alias("sha256"))
    counts = {r["status"]: r["count"] for r in manifest.verify_diff(then, now).groupBy("status").count().collect()}
    return {"trusted": any(votes.count(v) >= 2 for v in votes)} | counts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella")
    sub = top.add_subparsers(dest="command", required=True)
    for name, call in (("analyze", analyze), ("similar", similar)):
        p = sub.add_parser(name)
        p.add_argument("roots", nargs="+")
        p.set_defaults(call=call, duplicate_cutoff=0.5, high_coverage=0.8)
        p.add_argument("--cache")
        if name == "similar":
            p.add_argument("--ext")
            p.add_argument("--duplicate-cutoff", type=float)
            p.add_argument("--high-coverage", type=float)
    for name, call in (("plan", plan), ("run", run)):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("destination")
        p.add_argument("--max-path-length", type=int, default=255)
        p.add_argument("--fat32", action="store_true")
        p.add_argument("--cache")
        p.add_argument("--journal")
        p.set_defaults(call=call)
        if name == "run":
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--on-moved", choices=["leave", "copy"], default="leave")
            p.add_argument("--mode", choices=["copy", "collapse"], default="copy")
            p.add_argument("--keep-newest", type=int, default=1)
            p.add_argument("--archive", action="store_true")
            p.add_argument("--protected-extensions", default="")
    for name, call in (("write-manifest", write_manifest), ("verify", verify)):
        p = sub.add_parser(name)
        p.add_argument("destination")
        p.set_defaults(call=call)
        if name == "write-manifest":
            p.add_argument("--source")
    for p in sub.choices.values():
        form = p.add_mutually_exclusive_group()
        form.add_argument("--json", action="store_true", help="a JSON report, as without this flag")
        form.add_argument("--text", action="store_true", help="a report of plain lines")
    return top


def as_text(report: dict, before: str = "") -> str:
    """One line for each value; sizes in bytes as people read them."""
    lines = []
    for key, value in report.items():
        name = before + key
        if isinstance(value, dict):
            lines.append(as_text(value, name + "."))
        elif isinstance(value, list):
            lines += [name + ": " + "  ".join(map(str, x.values())) for x in value]
        else:
            lines.append(f"{name}: {format_bytes(value) if 'bytes' in key and value is not None else value}")
    return "\n".join(x for x in lines if x)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    report = a.call(session(), a)
    print(as_text(report) if a.text else json.dumps(report, indent=2, default=str))
    failed = report.get("failed") or report.get("trusted") is False or report.get("changed") or report.get("deleted")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
