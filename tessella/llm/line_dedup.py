"""Line dedup: lines that spread over many sites are boilerplate and are removed everywhere.

1. One pass over whole texts gives (line hash, site) pairs, each once a batch.
2. A HyperLogLog sketch of sites per line hash is built and merged by aggregation (map-side first), so
   a line in a third of all documents costs one sketch a task.
3. Lines whose estimate is clearly below or above ``min_sites`` are decided by it. For those within
   ``band`` deviations the sites are counted exactly.
4. A second pass removes the boilerplate lines from whole texts. Up to ``broadcast_lines`` hashes go to
   the tasks; beyond that, lines are joined by hash and documents get the places to drop.

A line is compared without white space around it; one that is only white space is never removed.
Lines are told apart by 64-bit hashes.

Defined results: null text stays null with no lines; a text all of whose lines go becomes empty, its
row stays; a null site counts as one site of its own; repeated rows don't add to a spread; an empty
table gives no rows; a text of any length is handled whole, by its lines; further columns are kept as
they are, also those with the names used here (give other names for ``lines`` and ``removed`` then).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.runtime import FEW, lean, materialize

_AROUND = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineConfig:
    min_sites: int = 10
    #: log2 of a sketch's registers; its relative deviation is 1.04 / sqrt(2 ** log_registers)
    log_registers: int = 12
    #: deviations around the threshold within which sites are counted exactly
    band: float = 5.0
    broadcast_lines: int = 2_000_000


def line_hash(line: str) -> int | None:
    """Signed 64-bit hash of a line without white space around it; None if nothing is left."""
    bare = line.strip(_AROUND)
    return xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) - (1 << 63) if bare else None


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs: dict[tuple[int, str | None], None] = {}
        for text, site in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if text.is_valid:
                for line in text.as_py().split("\n"):
                    if (h := line_hash(line)) is not None:
                        pairs[h, site] = None
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in pairs], pa.int64()), pa.array([s for _, s in pairs], pa.string())], names=["line", "site"]
        )


def boilerplate(docs: DataFrame, config: LineConfig = LineConfig(), text: str = "text", site: str = "source") -> DataFrame:
    """(line, sites) of every line hash on at least ``min_sites`` sites; sites is exact near the
    threshold and an estimate beyond it."""
    plain = lean(docs).select(F.col(text).cast("string").alias("text"), F.col(site).cast("string").alias("site"))
    spread = plain.mapInArrow(_spreads, "line long, site string")
    # a site's name gets a mark before it, so that a null site differs from every named one
    named = F.when(F.col("site").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "site"))
    sketched = spread.groupBy("line").agg(F.hll_sketch_agg(named, F.lit(config.log_registers)).alias("sketch"))
    estimated = materialize(
        sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= config.min_sites / 2), "spread", FEW
    )
    slack = 1 + config.band * config.min_sites * 1.04 / 2 ** (config.log_registers / 2)
    near = F.abs(F.col("sites") - config.min_sites) <= slack
    unsure = estimated.filter(near).select("line")
    exact = (
        spread.join(unsure, "line", "left_semi").select("line", named.alias("site")).distinct()
        .groupBy("line").agg(F.count("*").alias("sites"))
    )
    return estimated.filter(~near).unionByName(exact).filter(F.col("sites") >= config.min_sites)


def _dropper(gone: np.ndarray, at: int):
    hashes = set(gone.tolist())

    def clean(text: str | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        kept, lines, removed = [], 0, 0
        for line in text.split("\n"):
            h = line_hash(line)
            lines += h is not None
            if h is not None and h in hashes:
                removed += 1
            else:
                kept.append(line)
        return "\n".join(kept) if removed else text, lines, removed

    def run(batches):
        for batch in batches:
            got = [clean(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array([g[0] for g in got], pa.string())
            columns += [pa.array([g[k] for g in got], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


def _line_places(batches):
    for batch in batches:
        keys, places, hashes = [], [], []
        for k, text in enumerate(batch.column(0)):
            for place, line in enumerate(text.as_py().split("\n") if text.is_valid else ()):
                if (h := line_hash(line)) is not None:
                    keys.append(k)
                    places.append(place)
                    hashes.append(h)
        ids = batch.column(1).take(pa.array(keys, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(places, pa.int32()), pa.array(hashes, pa.int64())], names=["text_id", "place", "line"])


def _dropped_by_join(docs: DataFrame, gone: DataFrame, text: str) -> list:
    """Columns and table of the way for very many boilerplate lines: equal texts share an id, so the
    places to drop are found once for each text and joined back by that id."""
    numbered = docs.withColumn("_text_id", F.sha2(F.col(text).cast("binary"), 256))
    lines = numbered.select(F.col(text), "_text_id").mapInArrow(_line_places, "text_id string, place int, line long")
    hits = lines.join(gone.select("line").distinct(), "line", "left_semi").groupBy("text_id").agg(F.collect_set("place").alias("_places"))
    return numbered.join(hits, numbered["_text_id"] == hits["text_id"], "left")


def drop_boilerplate(
    docs: DataFrame, config: LineConfig = LineConfig(), text: str = "text", site: str = "source", lines: str = "n_lines", removed: str = "n_removed"
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus how many lines with content each
    text had and how many went."""
    gone = materialize(boilerplate(docs, config, text, site), "boilerplate", FEW)
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    at = docs.columns.index(text)
    if gone.count() <= config.broadcast_lines:
        hashes = np.asarray(gone.select("line").toArrow()["line"].to_numpy(), np.int64)
        out = T.StructType([*fields, T.StructField("lines", T.LongType()), T.StructField("removed", T.LongType())])
        return docs.toDF(*(f.name for f in fields)).mapInArrow(_dropper(hashes, at), out).toDF(*docs.columns, lines, removed)
    joined = _dropped_by_join(docs.toDF(*(f.name for f in fields)), gone, f"c{at}")
    parts = F.split(F.col(f"c{at}"), "\n", -1)
    places = F.coalesce(F.col("_places"), F.array().cast("array<int>"))
    kept = F.array_join(F.filter(parts, lambda _, k: ~F.array_contains(places, k)), "\n")
    n = F.size(F.filter(parts, lambda x: F.translate(x, _AROUND, "") != ""))
    cleaned = [F.when(F.size(places) > 0, kept).otherwise(F.col(f"c{k}")) if k == at else F.col(f"c{k}") for k in range(len(fields))]
    counts = [F.when(F.col(f"c{at}").isNull(), 0).otherwise(n).cast("long"), F.size(places).cast("long")]
    return joined.select(*cleaned, *counts).toDF(*docs.columns, lines, removed)
