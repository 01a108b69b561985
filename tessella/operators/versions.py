"""Version families from similar pairs, their ranking, and which copies to keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import extension, path_key
from tessella.operators.components import connected_components
from tessella.operators.duplicates import duplicate_members
from tessella.runtime import materialize


@dataclass(frozen=True)
class CollapseConfig:
    keep_newest: int = 1
    archive: bool = False
    protected_extensions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.keep_newest < 1:
            raise ValueError("keep_newest must be at least 1")


def flagged(pairs: DataFrame) -> DataFrame:
    """Diverged pairs: never merged, left for a person."""
    return pairs.filter("relationship = 'diverged'")


def cover_edges(pairs: DataFrame) -> DataFrame:
    """(holder, held): ``holder`` has what ``held`` has; near duplicates hold each other."""
    forth = pairs.filter("relationship IN ('near_duplicate', 'a_is_more_complete')").select(F.col("a").alias("holder"), F.col("b").alias("held"))
    back = pairs.filter("relationship IN ('near_duplicate', 'b_is_more_complete')").select(F.col("b").alias("holder"), F.col("a").alias("held"))
    return forth.unionByName(back)


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transitive closure by doubling: each round joins only pairs that the last one found with all that are known,
    until no pair is new."""
    known = new = materialize(edges.distinct(), "closure")
    for _ in range(max_rounds):
        ends = lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.held") == F.col("y.holder")).select(F.col("x.holder"), F.col("y.held"))
        step = ends(new, known).unionByName(ends(known, new)).distinct()
        new = materialize(step.join(known, ["holder", "held"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError("closure did not settle")


def families(pairs: DataFrame, files: DataFrame, count_self: bool = True) -> DataFrame:
    """(family, path, rank, completeness, is_tip): families are named by their least path; members are
    ranked by how many members they hold, then newest, then by path. With ``count_self`` a member on a
    cycle of holders counts itself."""
    merged = pairs.filter("relationship != 'diverged'").select("a", "b", "relationship")
    # near duplicates hold each other, and so do all that they connect: these are one class, and classes hold classes
    near = materialize(connected_components(merged.filter("relationship = 'near_duplicate'")).select(F.col("node").alias("path"), F.col("component").alias("class")), "near")
    one_way = materialize(cover_edges(merged.filter("relationship != 'near_duplicate'")), "one_way")
    ends = one_way.select(F.col("holder").alias("path")).unionByName(one_way.select(F.col("held").alias("path"))).distinct()
    member = near.unionByName(ends.join(near, "path", "left_anti").withColumn("class", F.col("path")))
    side = lambda x: member.select(F.col("path").alias(x), F.col("class").alias(f"{x}_class"))
    # an edge within a class adds nothing: its ends hold each other already
    across = one_way.join(side("holder"), "holder").join(side("held"), "held").select(F.col("holder_class").alias("holder"), F.col("held_class").alias("held"))
    across = materialize(across.filter("holder != held").distinct(), "across")
    family = connected_components(across, "holder", "held").select(F.col("node").alias("class"), F.col("component").alias("family"))
    member = member.join(family, "class", "left").withColumn("family", F.coalesce("family", "class"))
    held = closure(across)
    sizes = member.groupBy("class").agg(F.count("*").alias("n"))
    others = held.filter("holder != held").join(sizes.withColumnRenamed("class", "held"), "held").groupBy(F.col("holder").alias("class")).agg(F.sum("n").alias("others"))
    # a cycle of classes: each holds itself, as a class of several members does
    cyclic = held.filter("holder = held").select(F.col("holder").alias("class"), F.lit(True).alias("cyclic"))
    covered = held.filter("holder != held").select(F.col("held").alias("class")).distinct().withColumn("under", F.lit(True))
    by_class = sizes.join(others, "class", "left").join(cyclic, "class", "left").join(covered, "class", "left")
    itself = F.when((F.col("n") > 1) | F.col("cyclic").isNotNull(), F.col("n") if count_self else F.col("n") - 1).otherwise(F.lit(0))
    by_class = by_class.select("class", (itself + F.coalesce("others", F.lit(0))).cast("long").alias("completeness"), F.when((F.col("n") > 1) | F.col("under").isNotNull(), True).alias("covered"))
    rows = member.join(by_class, "class").join(files.select("path", "mtime_ms"), "path", "left")
    order = Window.partitionBy("family").orderBy(F.desc("completeness"), F.desc(F.coalesce("mtime_ms", F.lit(0))), path_key(F.col("path")))
    return rows.select("family", "path", F.row_number().over(order).alias("rank"), "completeness", F.col("covered").isNull().alias("is_tip"))


def collapse_decisions(files: DataFrame, ranked: DataFrame, config: CollapseConfig = CollapseConfig(), hashes: DataFrame | None = None) -> DataFrame:
    """(path, size, action, reason): exact duplicates first, then families, then all others are kept.
    ``hashes`` (path, size, hash) if they are known; else contents are hashed."""
    drop = "archive" if config.archive else "collapse"
    copies = duplicate_members(files if hashes is None else hashes).select("path", "first_path")
    rows = files.select("path", "size").join(copies, "path", "left").join(ranked.select("path", "rank", "is_tip"), "path", "left")
    protected = F.coalesce(extension(F.col("path")).isin([e.lower() for e in config.protected_extensions]), F.lit(False)) if config.protected_extensions else F.lit(False)
    reason = (
        F.when(F.col("first_path") == F.col("path"), "kept").when(F.col("first_path").isNotNull(), "exact_duplicate")
        .when(F.col("rank").isNull(), "kept").when(protected, "protected").when(F.col("is_tip"), "tip")
        .when(F.col("rank") <= config.keep_newest, "within_keep_newest").otherwise("older_version")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("path", "size", F.when(F.col("reason").isin("exact_duplicate", "older_version"), drop).otherwise("keep").alias("action"), "reason")


def collapse_summary(decisions: DataFrame) -> DataFrame:
    gone = F.col("action") != "keep"
    return decisions.agg(
        F.count_if(~gone).alias("files_kept"), F.count_if(gone).alias("files_collapsed"),
        F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("bytes_saved"),
        F.coalesce(F.sum(F.when(F.col("action") == "archive", F.col("size"))), F.lit(0)).alias("archived_bytes"),
    )


def apply_collapse(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """A reconcile plan without collapsed files, and with archived ones sent to ``_collapsed/``; only
    files that would be copied are touched."""
    d = decisions.select(F.col("path").alias("relative_path"), "action")
    rows = plan.join(d, "relative_path", "left")
    open_ = F.col("state").isin("missing", "partial")
    rows = rows.filter(~(open_ & (F.coalesce("action", F.lit("")) == "collapse")))
    moved = F.when(open_ & (F.col("action") == "archive"), F.concat(F.lit("_collapsed/"), "relative_path")).otherwise(F.col("relative_path"))
    return rows.withColumn("relative_path", moved).drop("action")
