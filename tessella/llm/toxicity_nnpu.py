"""Toxicity: non-negative positive-unlabelled learning on hashed words and word beginnings.

Confirmed toxic documents are the positives; all other text is unlabelled, neither clean nor toxic.
A linear classifier over binary features is trained in numpy on the driver with the non-negative PU
risk ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` under the logistic loss, where ``pi`` is the class
prior. While the corrected negative risk is below ``-beta`` the step goes against it, as in the
published estimator. At 0.5 the score splits the classes by that risk.

* Features of a word are the word, and its first 4 and 6 bytes, lower-cased and hashed to ``bits`` bits;
  a document has each feature or not, so a single word counts the same in a long text as in a short one.
* How many documents have a feature is counted over every training text in one pass with one vector of
  counters a task. The ``features`` most enriched in positives enter the classifier.
* The positives (``max_positive``) and the unlabelled sample (``max_unlabelled``) the classifier is
  fitted on are bounded: the first by a hash of key and text. They are turned into features where they
  are; only these, a few numbers a document, are brought together.
* Scoring is one pass over whole texts; the model is a few thousand numbers.

Defined results: null and empty texts have no feature and get the score of that; a null key counts as
held in and is not learned from; contradictory label rows of a document count as toxic; without any
positive the score is 0; repeated rows get equal scores; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import lean

#: Bytes handled at once; a part ends at a word's end.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicConfig:
    bits: int = 20
    features: int = 4096
    max_positive: int = 5_000
    max_unlabelled: int = 20_000
    min_positive_docs: int = 3
    #: A feature enters if its share among positives is this many times that among all texts,
    #: and this many standard deviations above it.
    lift: float = 2.0
    deviations: float = 4.0
    steps: int = 400
    rate: float = 0.1
    l1: float = 3e-4
    beta: float = 0.01
    seed: int = 29


@dataclass(frozen=True)
class ToxicModel:
    slot: np.ndarray  # bucket -> place among the features, or -1
    weights: np.ndarray
    bias: float
    bits: int


#: Byte classes: ASCII letters and all bytes beyond ASCII belong to words; capitals are lowered.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[97:123] = _WORD[65:91] = _WORD[128:] = True


def _powers(n: int, step: np.uint64) -> np.ndarray:
    out = np.full(n + 1, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(4096, _ODD)


def _mix(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - bits)).astype(np.int64)


def features(data: bytes, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all words of UTF-8 ``data`` and of their first 4 and 6 bytes, with repeats."""
    for part in _parts(data):
        raw = np.frombuffer(part, np.uint8)
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = _WORD[raw]
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, end = edges[::2], edges[1::2]
        if not len(start):
            continue
        # A polynomial hash of each word: bytes times powers of an odd number, by place in the word.
        place = np.arange(len(raw)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(raw)]])))
        value = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _POWER[place & 4095]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        yield _mix(sums[end] - sums[start], 1, bits)
        for kind, n in ((2, 4), (3, 6)):
            long = end - start > n
            yield _mix(sums[start[long] + n] - sums[start[long]], kind, bits)


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        stop = at + PIECE
        while stop < len(data) and _WORD[data[stop]]:
            stop += 1
        yield data[at:stop]
        at = stop
    yield data[at:]


def _distinct(data: bytes, bits: int, slot: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, or distinct places of its chosen features."""
    found = []
    for h in features(data, bits):
        if slot is not None:
            h = slot[h]
            h = h[h >= 0]
        found.append(np.unique(h))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield x.as_py() or b""


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _counter(bits: int):
    def count(batches):
        all_docs, positives = np.zeros((1 << bits) + 1, np.int64), np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            for data, positive in zip(_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                ids = np.append(_distinct(data, bits), 1 << bits)  # the last counts documents
                all_docs[ids] += 1
                if positive:
                    positives[ids] += 1
        at = np.flatnonzero(all_docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(all_docs[at]), pa.array(positives[at])], names=["bucket", "n", "p"]
        )

    return count


def _extractor(slot: np.ndarray, bits: int):
    def extract(batches):
        for batch in batches:
            ids = [_distinct(d, bits, slot).astype(np.int32) for d in _bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column(1)], names=["ids", "h"])

    return extract


def select_features(n: np.ndarray, p: np.ndarray, docs: int, positives: int, config: ToxicConfig) -> np.ndarray:
    """Buckets whose share among positives most exceeds their share among all, by a z-score."""
    share, expected = p / max(positives, 1), n / max(docs, 1)
    spread = np.sqrt(expected * (1 - np.minimum(expected, 1)) / max(positives, 1) + 1e-12)
    score = np.where((p >= config.min_positive_docs) & (share >= config.lift * expected), (share - expected) / spread, -np.inf)
    order = np.lexsort((np.arange(len(score)), -score))[: config.features]
    return order[score[order] >= config.deviations]


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, config: ToxicConfig) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model under the non-negative PU risk plus an l1 penalty.

    Rows are arrays of feature places. Full-batch Adam on the least subgradient, so that a feature
    whose pull on the risk stays below ``l1`` keeps the weight zero."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    laid = [(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)) for rows in (positive, unlabelled)]

    def risk(data: tuple[np.ndarray, np.ndarray, int], sign: float) -> tuple[float, np.ndarray]:
        """Mean logistic loss of rows as class ``sign``, and its gradient."""
        ids, owner, rows = data
        score = np.bincount(owner, w[ids], rows) + w[-1]
        slope = -sign / (1 + np.exp(np.clip(sign * score, -50, 50))) / rows
        grad = np.append(np.bincount(ids, slope[owner], size), slope.sum())
        return float(np.logaddexp(0, -sign * score).mean()), grad

    for t in range(1, config.steps + 1):
        (_, gp), (rn, gn), (ru, gu) = risk(laid[0], 1), risk(laid[0], -1), risk(laid[1], -1)
        grad = prior * gp + gu - prior * gn if ru - prior * rn >= -config.beta else prior * gn - gu
        pull, inner = grad[:-1], w[:-1]
        grad[:-1] = np.where(inner != 0, pull + config.l1 * np.sign(inner), np.sign(pull) * np.maximum(np.abs(pull) - config.l1, 0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        moved = w - config.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        moved[:-1][moved[:-1] * inner < 0] = 0  # a weight stops at zero before it changes its sign
        w = moved
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig()) -> ToxicModel | None:
    """Model from docs (key, text) and labels (key, toxic); None without positives."""
    learn = docs.filter(F.col("key").isNotNull() & ~held_out(F.col("key")))
    known = labels.filter(F.col("key").isNotNull() & ~held_out(F.col("key")) & F.col("toxic").isNotNull())
    by_doc = known.groupBy("key").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    seen = by_doc.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not seen["p"]:
        return None
    prior = float(np.clip(seen["p"] / seen["n"], 0.001, 0.9))
    picked = by_doc.filter("toxic = 1").orderBy(F.xxhash64("key", F.lit(config.seed)), "key").limit(config.max_positive).select("key")
    chosen = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)  # at most max_positive keys
    marked = learn.join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "key", "left").select(
        "key", "text", F.coalesce("positive", F.lit(False)).alias("positive")
    )
    counted = marked.select("text", "positive").mapInArrow(_counter(config.bits), "bucket int, n long, p long")
    got = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toArrow()
    n, p = np.zeros((1 << config.bits) + 1, np.int64), np.zeros((1 << config.bits) + 1, np.int64)
    n[got["bucket"].to_numpy()], p[got["bucket"].to_numpy()] = got["n"].to_numpy(), got["p"].to_numpy()
    if not p[-1]:
        return None
    buckets = select_features(n[:-1], p[:-1], int(n[-1]), int(p[-1]), config)
    slot = np.full(1 << config.bits, -1, np.int32)
    slot[buckets] = np.arange(len(buckets))
    rate = min(1.0, config.max_unlabelled / max(int(n[-1]), 1))
    h = F.xxhash64("key", "text", F.lit(config.seed + 1))
    drawn = F.pmod(h, F.lit(1 << 30)) < int(min(1.0, 1.1 * rate) * (1 << 30))
    extract = _extractor(slot, config.bits)
    sets = [
        marked.filter(rows).select("text", h.alias("h")).mapInArrow(extract, "ids array<int>, h long")
        .orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(most).toArrow()["ids"]
        for rows, most in ((F.col("positive"), config.max_positive), (drawn, config.max_unlabelled))
    ]
    xp, xu = ([x.values.to_numpy() for x in s] for s in sets)
    if not xp or not xu:
        return None
    w, bias = fit_nnpu(xp, xu, len(buckets), prior, config)
    return ToxicModel(slot, w.astype(np.float64), bias, config.bits)


def score_text(data: bytes, model: ToxicModel | None) -> float:
    if model is None:
        return 0.0
    x = model.weights[_distinct(data, model.bits, model.slot)].sum() + model.bias
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def _scorer(model: ToxicModel | None):
    def score(batches):
        for batch in batches:
            s = [score_text(d, model) for d in _bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                names=[*batch.schema.names[:2], "score", "predicted"],
            )

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``."""
    plain = lean(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    model = train(plain, labels.select(F.col(key).alias("key"), "toxic"), config)
    kind = docs.schema[key].dataType.simpleString()
    out = plain.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "text")
    return out.mapInArrow(_scorer(model), f"`{key}` {kind}, held_out boolean, score double, predicted int")
