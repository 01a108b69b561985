"""Corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
for the next. All but the last return the columns of ``documents``, whatever these are called.

Defined results: rows without an id, and rows that share one, are told apart by their texts; rows with
null text or without any letter are rejected by the first stage; a text all of whose lines are boilerplate
stays as an empty one; equal rows are copies, of which the near-duplicate stage keeps one; texts of any
length are handled whole; an empty table goes through all stages; extra columns are kept, also those with
names that the operators use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.catalogue import source_domain
from tessella.llm.jaccard_join import surplus, text_hash
from tessella.llm.langid_ftrl import UND, tag_languages
from tessella.llm.line_dedup import drop_boilerplate
from tessella.llm.mixing import MixConfig, mix
from tessella.llm.piece_sampling import SampleConfig, encode
from tessella.runtime import FEW, columns, fresh, materialize, table

#: The mixture keeps most of what is clean; no document is taken twice.
MIX = MixConfig(percent=90, max_epochs=1, domain_weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, lang_weights={"en": 5, "de": 2, "fr": 2, "es": 1})

#: A document stays if its language is likelier than all others together.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: those without a letter go, and those for which no
    language is likelier than all others together. A document without a language gets the predicted one."""
    pred, score = fresh(docs, "lang_pred", "lang_score")
    known = tag_languages(docs, predicted=pred, score=score).filter((F.col(pred) != UND) & (F.col(score) >= MIN_SCORE))
    return known.withColumn("lang", F.coalesce("lang", pred)).select(*columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that spread over many sources; n_chars follows the text."""
    lines, removed = fresh(docs, "n_lines", "n_removed")
    cleaned = drop_boilerplate(docs, lines=lines, removed=removed)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least id, then the least hash of its
    text; rows without an id come last, but are documents as any other. Rows are told apart by id and
    text. Texts stay in place while the pairs of both that go are few enough to broadcast; beyond that
    they are shuffled by them."""
    key, own, goes, wordless, rest = fresh(docs, "_id", "_hash", "_goes", "_wordless", "_rest")
    marks = materialize(surplus(docs).toDF(key, own, goes, wordless), "marks", FEW)
    side = F.broadcast(marks) if marks.count() <= 1_000_000 else marks
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (text_hash() == F.col(own))
    single = docs.join(side, same, "left_anti")
    twice = marks.filter(~F.col(goes))
    if twice.isEmpty():
        return single
    # rows that repeat an id and a text which stay: one of them; of wordless texts only equal rows are copies
    repeated = docs.join(F.broadcast(twice) if side is not marks else twice, same)
    others = F.struct(*(c for c, name in zip(columns(docs), docs.columns, strict=True) if name not in ("doc_id", "text")))
    once = repeated.filter(~F.col(wordless)).groupBy("doc_id", own).agg(F.min(others).alias(rest), F.first("text").alias("text"))
    once = once.select("doc_id", "text", f"{rest}.*").select(*columns(docs))
    bare = repeated.filter(F.col(wordless)).select(*columns(docs)).distinct()
    return single.unionByName(once).unionByName(bare)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of domains, languages and sources."""
    (epoch,) = fresh(docs, "epoch")
    return mix(docs, source_domain(), MIX, epoch=epoch).select(*columns(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left."""
    return encode(docs, SampleConfig())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: A trained classifier and a sampler are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
