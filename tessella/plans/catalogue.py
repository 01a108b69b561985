"""Queries over the standard tables, and the SQL that each is checked against.

``documents`` stand for files: path ``source/lang/doc_<id>.txt``, the text as content, its UTF-8 length
as size and the id in seconds as time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import dates, policy
from tessella.functions import text as T
from tessella.operators import duplicates, manifest, reconcile, similarity, versions
from tessella.runtime import materialize, table
from tessella.sources import store


def files(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"), "text", (F.col("doc_id") * 1000).alias("mtime_ms"))


FILES = """f AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc_' || doc_id || '.txt' AS path,
  strlen(text)::BIGINT AS size, text, doc_id * 1000 AS mtime_ms FROM documents WHERE text IS NOT NULL)"""


def scan_summary(spark, d):
    return files(spark, d).groupBy(F.element_at(F.split("path", "/"), 1).alias("root")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def ignore_filter(spark, d):
    names = F.concat(F.lit("root/"), F.when(F.col("doc_id") % 5 == 0, "._x").when(F.col("doc_id") % 5 == 1, "Thumbs.db").when(F.col("doc_id") % 5 == 2, "~$a.docx").otherwise("keep.txt"))
    return table(spark, d, "documents").select("doc_id", names.alias("path")).filter(~T.is_ignored(F.col("path")))


def scan_union_roots(spark, d):
    a = files(spark, d).select("path", "size")
    return a.filter("size % 2 = 0").unionByName(a.filter("size % 3 = 0")).dropDuplicates(["path"])


def classify_kinds(spark, d):
    ext = F.element_at(F.array(*(F.lit(x) for x in ["txt", "HTML", "json", "csv", "py", "docx", "bin", "tar.gz", "YML", "rtf"])), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("a/file."), ext).alias("path"))
    return rows.groupBy("path", T.extension(F.col("path")).alias("extension"), T.kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


def size_groups(spark, d):
    return duplicates.size_groups(files(spark, d))


def sample_prefilter(spark, d):
    return duplicates.sample_survivors(files(spark, d)).select("path", "size")


def exact_duplicates(spark, d):
    return duplicates.duplicate_groups(files(spark, d))


def dup_representatives(spark, d):
    return duplicates.representatives(files(spark, d)).select("path", "size")


def analyze_report(spark, d):
    return duplicates.analyze_report(files(spark, d))


def _cache(spark, d):
    f = files(spark, d).filter("doc_id % 3 != 0")
    age = F.col("mtime_ms") + F.col("doc_id") % 5 * 1000
    return f.select("path", "size", age.alias("mtime_ms"), F.when(F.col("doc_id") % 2 == 0, F.md5("content")).alias("sample_hash"), F.sha2("content", 256).alias("full_hash"))


def cache_lookup(spark, d):
    return duplicates.cache_lookup(files(spark, d).select("path", "size", "mtime_ms"), _cache(spark, d))


def cache_upsert(spark, d):
    f = files(spark, d).filter("doc_id % 4 != 0")
    fresh = f.select("path", "size", "mtime_ms", F.md5("content").alias("sample_hash"), F.lit(None).cast("string").alias("full_hash"))
    return duplicates.cache_upsert(_cache(spark, d), fresh)


def token_sets(spark, d):
    t = files(spark, d).select("doc_id", F.explode(T.shingle_tokens(F.col("text"))).alias("token"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.min("token").alias("least"), F.max("token").alias("most"))


def _hashed(spark, d) -> DataFrame:
    """(path, size, mtime_ms, hash) of all files: contents are read and hashed once for all steps."""
    f = files(spark, d)
    return materialize(f.select("path", "size", "mtime_ms", F.sha2("content", 256).alias("hash")), "hashed")


def _pairs(spark, d, known: DataFrame, links: bool = False) -> DataFrame:
    return similarity.similar_pairs(duplicates.representatives(files(spark, d).select("path", "text"), known), links=links)


def similar_pairs(spark, d):
    return _pairs(spark, d, _hashed(spark, d))


def coverage_pairs(spark, d):
    """Both measures of every document and the one with the next id."""
    f = files(spark, d).select("doc_id", T.shingle_tokens(F.col("text")).alias("t"))
    a = f.select((F.col("doc_id") + 1).alias("b"), F.col("doc_id").alias("a"), F.col("t").alias("ta"))
    pairs = a.join(f.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b")
    return pairs.select("a", "b", T.coverage(F.col("ta"), F.col("tb")).alias("a_to_b"), T.dice(F.col("ta"), F.col("tb")).alias("dice"))


def _ranked(spark, d):
    """Files without contents, and their ranked families."""
    known = _hashed(spark, d)
    links = materialize(_pairs(spark, d, known, links=True), "links")
    return known, materialize(versions.families(links, known), "ranked")


def version_families(spark, d):
    return _ranked(spark, d)[1]


def flagged_diverged(spark, d):
    return versions.flagged(similar_pairs(spark, d))


def collapse_decisions(spark, d):
    known, ranked = _ranked(spark, d)
    return versions.collapse_decisions(known, ranked)


def collapse_summary(spark, d):
    return versions.collapse_summary(collapse_decisions(spark, d))


def apply_collapse(spark, d):
    """The plan of two trees after collapse, which archives here."""
    known, ranked = _ranked(spark, d)
    decided = versions.collapse_decisions(known, ranked, versions.CollapseConfig(archive=True))
    return versions.apply_collapse(reconcile_states(spark, d), decided).select("relative_path", "size", "state")


def preflight_issues(spark, d):
    odd = F.concat("path", F.when(F.col("doc_id") % 4 == 0, "?.txt").when(F.col("doc_id") % 4 == 1, "/con.log").when(F.col("doc_id") % 4 == 2, " ").otherwise(F.repeat(F.lit("x"), F.lit(250))))
    rows = files(spark, d).select("doc_id", odd.alias("path"))
    return rows.select("doc_id", F.array_join(policy.path_issues(F.col("path")), ",").alias("issues"))


def path_collision(spark, d):
    rows = files(spark, d).select(F.when(F.col("doc_id") % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("p"), "doc_id")
    return reconcile.path_collisions(rows.select(F.concat(F.lit("r\\"), F.substring("p", 1, 8)).alias("relative_path")))


def trees(spark, d) -> tuple[DataFrame, DataFrame]:
    """A source tree, and a destination derived from it with every kind of difference."""
    f = files(spark, d)
    source = f.select("doc_id", F.col("path").alias("relative_path"), "size", F.sha2("content", 256).alias("hash"))
    x = F.col("doc_id")
    text = F.when(x % 7 == 2, F.substring("text", 1, 3)).when(x % 7 == 3, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    path = F.when(x % 7 == 1, F.concat(F.lit("moved/"), "path")).when(x % 11 == 4, F.upper("path")).otherwise(F.col("path"))
    kept = f.filter(x % 5 != 0).select(path.alias("relative_path"), text.alias("text"))
    extra = f.filter(x % 13 == 0).select(F.concat(F.lit("extra/"), "path").alias("relative_path"), F.concat(F.lit("only here "), "path").alias("text"))
    dest = kept.unionByName(extra)
    dest = dest.select("relative_path", F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    # texts are read and hashed once, however often a plan joins its sides
    return materialize(source, "source"), materialize(dest, "destination")


def reconcile_states(spark, d):
    return reconcile.plan(*trees(spark, d)).withColumn("issues", F.array_join("issues", ","))


def reconcile_summary(spark, d):
    return reconcile.summary(reconcile_states(spark, d))


def transfer_summary(spark, d):
    return reconcile.transfer_summary(reconcile_states(spark, d))


def journal_counts(spark, d):
    entries = reconcile.journal_entries(reconcile.plan(*trees(spark, d)), 1)
    return entries.groupBy("run_id", "state").agg(F.count("*").alias("n"), F.count("detail").alias("n_detail"))


def manifest_files(spark, d):
    return manifest.file_records(files(spark, d))


def manifest_dup_groups(spark, d):
    return manifest.duplicate_groups(manifest_files(spark, d))


def verify_diff(spark, d):
    source, dest = trees(spark, d)
    name = lambda t: t.select("relative_path", F.col("hash").alias("sha256"))
    return manifest.verify_diff(name(source), name(dest))


def integrity_vote(spark, d):
    h = lambda k: F.when(F.col("doc_id") % k != 0, F.md5((F.col("doc_id") % (k + 1)).cast("string").cast("binary")))
    return table(spark, d, "documents").select("doc_id", manifest.majority(h(2), h(3), h(5)).alias("trusted"))


def header_dates(spark, d):
    x = F.col("event_id")
    mail = F.concat(F.lit("Mon, "), (x % 28 + 1).cast("string"), F.lit(" Feb 2021 10:"), F.format_string("%02d", x % 60), F.lit(":07 +0130"))
    office = F.format_string("20%02d-03-%02dT04:05:06Z", x % 30, x % 28 + 1)
    return table(spark, d, "events").select("event_id", dates.rfc5322_millis(mail).alias("mail_ms"), dates.w3cdtf_millis(office).alias("office_ms"))


def duplicate_paths(spark, d):
    return manifest.duplicate_paths(manifest_files(spark, d))


def manifest_families(spark, d):
    return manifest.named_families(_ranked(spark, d)[1])


def journal_runs(spark, d):
    """Counts of two runs: a plan there and back, and the first one's transfers."""
    a, b = trees(spark, d)
    there, back = reconcile.plan(a, b), reconcile.plan(b, a)
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    entries = reconcile.journal_entries(there, 1).unionByName(reconcile.journal_entries(back, 2))
    events = there.filter("state IN ('missing', 'partial')").select(F.lit(1).cast("long").alias("run_id"))
    return store.counts(runs, entries, events).join(store.latest_run(runs).withColumn("latest", F.lit(True)), "run_id", "left").fillna(False, ["latest"])


def best_dates(spark, d):
    """Dates of events written as different files state them."""
    x, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    source = F.element_at(F.array(*map(F.lit, ["office_metadata", "exif", "email_header", "exif"])), (x % 4 + 1).cast("int"))
    raw = (
        F.when(x % 4 == 0, F.concat(day, F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("Z"))).when(x % 4 == 1, F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
        .when(x % 4 == 2, F.date_format("ts", "d MMM yyyy HH:mm:ss Z")).otherwise("no date")
    )
    millis, origin = dates.best_date(raw, source, x * 1000)
    return table(spark, d, "events").select("event_id", millis.alias("date_ms"), origin.alias("date_source"))


def media_dice(spark, d):
    """Dice of the kinds of events that neighbouring users have."""
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.concat("event_type", F.lit("-"), F.col("event_id") % 7))).alias("media"))
    files_ = kinds.select(F.col("user_id").cast("string").alias("path"), "media")
    pairs = kinds.select(F.col("user_id").cast("string").alias("a"), (F.col("user_id") + 1).cast("string").alias("b"))
    return similarity.with_media(pairs, files_)


_NAMES = """scan_summary ignore_filter scan_union_roots classify_kinds size_groups sample_prefilter exact_duplicates dup_representatives
analyze_report cache_lookup cache_upsert token_sets similar_pairs coverage_pairs version_families flagged_diverged collapse_decisions
collapse_summary apply_collapse preflight_issues path_collision reconcile_states reconcile_summary transfer_summary journal_counts manifest_files
manifest_dup_groups verify_diff integrity_vote header_dates duplicate_paths manifest_families journal_runs best_dates media_dice""".split()


def queries() -> dict[str, Callable]:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    from tessella.plans.oracles import oracles

    return oracles()
