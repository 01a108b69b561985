"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree: each node's budget is divided
among its children by weight. A child can't take more than its capacity (its tokens times
``max_epochs``); what it leaves is divided among its siblings by weight again, and only what a whole
family cannot take is left to the siblings of its parent, and so on up. That is water-filling at each
level with capacities summed over subtrees; levels are found with windows over node summaries.

A leaf whose budget is ``e`` whole epochs and a rest takes all its documents ``e`` times, and then the
token prefix of epoch ``e``: documents in the order of a hash of (seed, epoch, key) while their running
tokens stay within the rest. The end of the prefix is found without sorting a leaf: tokens are summed by
(leaf, first hash digits), which gives the digits the prefix ends in, and only documents with these are
ordered. What results is one hash per leaf, so texts are filtered in place and never shuffled.

Defined results: null domain, language and source act as empty strings; a null key as an empty one; null
texts have no tokens; rows that repeat a key in a leaf are taken or left together; a weight that isn't
given is 1; a leaf without tokens gets no budget, its documents go; texts of any length are counted whole;
an empty table gives no rows; other columns are kept, also those with the names used here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import FEW, SOME, columns, fresh, materialize

LEAF = ["domain", "lang", "source"]
#: Hex digits of the hash by which tokens are summed.
DIGITS = 3


@dataclass(frozen=True)
class MixConfig:
    """``percent`` of all tokens is the budget; weights are whole numbers by name of a node."""

    percent: int = 50
    max_epochs: int = 2
    seed: int = 17
    domain_weights: dict[str, int] = field(default_factory=dict)
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    broadcast_leaves: int = 100_000


def count_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def order_hash(key: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _weight(name: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col(name)), F.lit(1)).cast("long")


def _filled(nodes: DataFrame, family: list[str], budget: str, out: str) -> DataFrame:
    """Adds ``out``: each node's share of its family's ``budget`` by ``weight``, at most ``cap``.

    With children by rising cap / weight, the level that child k would get is what the children before
    it leave, over the weights from it on; the first child that is not filled at its level sets it."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    rising = w.orderBy(F.col("cap") / F.col("weight"), *LEAF[: len(family) + 1])
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns(
        {
            "_before": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
            "_weights": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    nodes = nodes.withColumn("_level", (F.col(budget) - F.col("_before")) / F.col("_weights"))
    unfilled = F.col("cap") / F.col("weight") > F.col("_level")
    nodes = nodes.withColumn("_open", F.when(unfilled, F.struct(F.row_number().over(rising).alias("k"), F.col("_level").alias("level"))))
    nodes = nodes.withColumn("_set", F.min("_open").over(w)["level"])
    share = F.when(F.col("_set").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("_set") * F.col("weight"))))
    return nodes.withColumn(out, F.greatest(share, F.lit(0)).cast("long")).drop("_before", "_weights", "_level", "_open", "_set", "weight", "cap")


def leaf_budgets(tokens: DataFrame, config: MixConfig) -> DataFrame:
    """(domain, lang, source, tokens, budget, full, rest) from documents' (domain, lang, source, tokens)."""
    leaves = tokens.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    leaves = materialize(leaves.withColumn("cap", F.col("tokens") * config.max_epochs), "leaves", FEW)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = total * config.percent // 100
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns(
        {"weight": _weight("domain", config.domain_weights), "all": F.lit(budget).cast("long")}
    )
    domains = _filled(domains, [], "all", "domain_budget").select("domain", "domain_budget")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight("lang", config.lang_weights))
    langs = _filled(langs.join(domains, "domain"), ["domain"], "domain_budget", "lang_budget").select("domain", "lang", "lang_budget")
    sources = leaves.join(langs, ["domain", "lang"]).withColumn("weight", _weight("source", config.source_weights))
    filled = _filled(sources, ["domain", "lang"], "lang_budget", "budget")
    return filled.select(
        *LEAF, "tokens", "budget", F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("full"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
    )


def leaf_prefixes(units: DataFrame, config: MixConfig) -> DataFrame:
    """(domain, lang, source, budget, full, last): ``last`` bounds the order hashes of the prefix.

    ``units``: (domain, lang, source, key, tokens)."""
    budgets = materialize(leaf_budgets(units, config), "budgets", FEW)
    small = budgets.count() <= config.broadcast_leaves
    side = F.broadcast(budgets) if small else budgets
    merged = units.groupBy(*LEAF, "key").agg(F.sum("tokens").alias("tokens"))  # repeated rows of a key together
    placed = merged.join(side.drop("tokens"), LEAF).withColumn("h", order_hash(F.col("key"), F.col("full"), config.seed))
    placed = materialize(placed.select(*LEAF, "h", "tokens", "rest"), "placed", SOME)
    digits = F.substring("h", 1, DIGITS).alias("digits")
    sums = placed.groupBy(*LEAF, "rest", digits).agg(F.sum("tokens").alias("tokens"))
    w = Window.partitionBy(*LEAF).orderBy("digits")
    ends = (
        sums.withColumn("upto", F.sum("tokens").over(w)).filter(F.col("upto") > F.col("rest"))
        .groupBy(*LEAF).agg(F.min(F.struct("digits", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
        .select(*LEAF, "end.digits", "end.before")
    )
    ends = materialize(ends, "ends", FEW)
    side = F.broadcast(ends) if small else ends
    inside = placed.withColumn("own", digits).join(side, LEAF).filter("own = digits")
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("h"))
    last = inside.withColumn("running", running).filter("running <= rest").groupBy(*LEAF).agg(F.max("h").alias("h"))
    return budgets.join(ends, LEAF, "left").join(last, LEAF, "left").select(
        *LEAF, "budget", "full", F.coalesce("h", "digits", F.lit("")).alias("last")
    )


def mix(
    docs: DataFrame, domain: Column, config: MixConfig = MixConfig(), key: str = "doc_id", text: str = "text",
    lang: str = "lang", source: str = "source", epoch: str = "epoch",
) -> DataFrame:
    """``docs`` once for each epoch it is taken in, with the number of the epoch."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = [name(domain).alias("domain"), name(F.col(lang)).alias("lang"), name(F.col(source)).alias("source")]
    k = F.col(key).cast("string").alias("key")
    units = materialize(docs.select(*leaf, k, count_tokens(F.col(text)).alias("tokens")), "units")
    plan = materialize(leaf_prefixes(units, config), "plan", FEW)
    *own, order_key, full, last, taken = fresh(docs, *(f"_leaf_{x}" for x in LEAF), "_order_key", "_full", "_last", "_taken")
    side = plan.select(*(F.col(x).alias(n) for x, n in zip(LEAF, own, strict=True)), F.col("full").alias(full), F.col("last").alias(last))
    keyed = docs.withColumns(dict(zip(own, leaf, strict=True)) | {order_key: k})
    joined = keyed.join(F.broadcast(side) if plan.count() <= config.broadcast_leaves else side, own)
    times = F.col(full) + (order_hash(F.col(order_key), F.col(full), config.seed) <= F.col(last)).cast("int")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(taken) - 1))
    return joined.withColumn(taken, times).filter(F.col(taken) > 0).select(*columns(docs), epochs.alias(epoch))
