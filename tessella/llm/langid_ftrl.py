"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters with single code points in between for everything else. The n-grams
of one, two and three characters are hashed into ``buckets``; the features of a text are their shares
(term frequency) times the inverse document frequency. The weights are learned with the
follow-the-regularised-leader (proximal) update under an elastic-net penalty, then one temperature is
fitted on part of the sample so that scores are calibrated probabilities.

* Document frequencies are counted over every training document in one pass: each task adds up a
  vector of ``buckets`` counters and emits it once, so what is shuffled grows with tasks, not texts.
* The classifier is fitted on the driver on a bounded, documented sample: ``per_lang`` documents of
  each language, and ``max_sample`` altogether, at most, first by a hash of key and text. They are
  turned into features where they are; only these are brought together.
* Prediction is one pass over whole texts. As features are linear in n-gram counts, the score of a
  text is a mean of table rows; nothing of the size of the vocabulary is built for a document.

Defined results: null text or a text without letters gets ``und`` with score 0; a null key counts as
held in, not held out, and takes no part in training; null language: not learned from; a corpus
without training rows predicts ``und`` everywhere; of equally likely languages the first by name is
predicted; repeated rows get equal predictions; texts of any length are read whole, in parts; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.runtime import lean

UND = "und"
#: Characters handled at once, so that memory is bounded for texts of any length.
PIECE = 1 << 18


@dataclass(frozen=True)
class LangConfig:
    bits: int = 16
    per_lang: int = 800
    max_sample: int = 12_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 1e-3
    calibration_share: float = 0.2
    seed: int = 13


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages: weight times idf over temperature
    bias: np.ndarray
    bits: int


@cache
def _normal() -> np.ndarray:
    """Lower-case letter of each code point; 32 for whatever is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Normalised code points with one space before and after."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(raw) + 2, 32, np.uint32)
    out[1:-1] = _normal()[raw]
    return out


def grams(chars: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams, an array for each order."""
    key = np.zeros(len(chars), np.uint64)
    wide = chars.astype(np.uint64)
    for n in range(3):
        if len(chars) <= n:
            return
        key = key[: len(wide) - n] | (wide[n:] << np.uint64(21 * n))
        mixed = (key ^ np.uint64(n << 62)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        yield ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def pieces(chars: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text that overlap by two characters; every n-gram starts in one of them."""
    for k in range(0, max(len(chars) - 2, 1), PIECE):
        yield chars[k : k + PIECE + 2]


def counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    out = np.zeros(1 << bits, np.int64)
    for part in pieces(letters(text)):
        for g in grams(part, bits):
            out += np.bincount(g, minlength=1 << bits)
    found = np.flatnonzero(out)
    return found, out[found]


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _frequency_counter(bits: int):
    def count(batches):
        total, docs = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                chars = letters(text.as_py())
                if not (chars != 32).any():
                    continue
                seen = np.zeros(1 << bits, bool)
                for part in pieces(chars):
                    for g in grams(part, bits):
                        seen[g] = True
                total += seen
                docs += 1
        found = np.flatnonzero(total)
        ids, n = np.append(found, -1), np.append(total[found], docs)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(n)], names=["bucket", "n"])

    return count


def _sampler(bits: int):
    def emit(batches):
        for batch in batches:
            rows = [counts(t.as_py(), bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())),
                    pa.array([b.astype(np.int32) for _, b in rows], pa.list_(pa.int32())),
                    batch.column(2),
                ],
                names=["lang", "ids", "n", "h"],
            )

    return emit


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, size: int, config: LangConfig) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size x classes) and bias by FTRL-proximal with l1 and l2 over sparse rows (ids, values, class)."""
    z, g2 = np.zeros((size + 1, n_classes)), np.zeros((size + 1, n_classes))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - config.l1, 0)
        return -shrunk / ((config.beta + np.sqrt(g2[at])) / config.alpha + config.l2)

    rng = np.random.default_rng(config.seed)
    for _ in range(config.epochs):
        for k in rng.permutation(len(rows)):
            ids, x, y = rows[k]
            at, x = np.append(ids, size), np.append(x, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[y] -= 1
            grad = x[:, None] * error
            grown = g2[at] + grad * grad
            z[at] += grad - (np.sqrt(grown) - np.sqrt(g2[at])) / config.alpha * w
            g2[at] = grown
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(truth):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(truth)), truth] + 1e-12).mean()
    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(labelled: DataFrame, config: LangConfig = LangConfig()) -> LangModel | None:
    """Model from (key, text, lang); None if there is nothing to learn from."""
    size = 1 << config.bits
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per_lang:
        return None
    langs = sorted(per_lang)
    counted = labelled.select("text").mapInArrow(_frequency_counter(config.bits), "bucket int, n long")
    freq = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1)  # the last place, bucket -1, has the number of documents
    df[freq["bucket"].to_numpy()] = freq["n"].to_numpy()
    n_docs, df = df[-1], df[:-1]
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    most = max(1, min(config.per_lang, config.max_sample // len(langs)))
    # half as many again are drawn by the hash, so that few rows are compared for the least hashes
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, (1.5 * most + 20) / per_lang[k]))))
    h = F.xxhash64(F.col("key"), F.col("text"), F.lit(config.seed))
    drawn = F.pmod(h, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    picked = labelled.filter(drawn).select("lang", "text", h.alias("h")).mapInArrow(_sampler(config.bits), "lang string, ids array<int>, n array<int>, h long")
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    sample = picked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    got = sample.orderBy("lang", "r").select("lang", "ids", "n").toArrow()
    rows = []
    for lang, ids, n in zip(got["lang"], got["ids"], got["n"], strict=True):
        ids, n = ids.values.to_numpy(), n.values.to_numpy()
        if len(ids) > 3:  # with letters: more than the 1-, 2- and 3-gram of spaces
            rows.append((ids, n / n.sum() * idf[ids], langs.index(lang.as_py())))
    if not rows:
        return None
    order = np.random.default_rng(config.seed).permutation(len(rows))
    cut = int(len(rows) * config.calibration_share)
    part, check = [rows[k] for k in order[cut:]], [rows[k] for k in order[:cut]]
    w, bias = fit_ftrl(part, len(langs), size, config)
    logits = np.array([x @ w[ids] + bias for ids, x, _ in check]).reshape(len(check), len(langs))
    t = fit_temperature(logits, np.array([y for *_, y in check], int))
    return LangModel(langs, (w * idf[:, None] / t).astype(np.float32), bias / t, config.bits)


def predict_text(text: str | None, model: LangModel | None) -> tuple[str, float]:
    chars = letters(text or "")
    if model is None or not (chars != 32).any():
        return UND, 0.0
    total, n = np.zeros(len(model.langs)), 0
    for part in pieces(chars):
        for g in grams(part, model.bits):
            # how often each row of the table is due, or the rows themselves where that is less
            total += np.bincount(g, minlength=len(model.table)) @ model.table if len(g) > len(model.table) else model.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
    p = _softmax(total / n + model.bias)
    k = int(p.argmax())
    return model.langs[k], float(p[k])


def _predictor(model: LangModel | None):
    def predict(batches):
        for batch in batches:
            got = [predict_text(t.as_py(), model) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())],
                names=[batch.schema.names[0], "held_out", "lang_pred", "score"],
            )

    return predict


def _tagger(model: LangModel | None, at: int):
    def tag(batches):
        for batch in batches:
            got = [predict_text(t.as_py(), model) for t in batch.column(at)]
            columns = [*batch.columns, pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return tag


def _learned(docs: DataFrame, config: LangConfig, key: str, text: str, lang: str) -> LangModel | None:
    plain = lean(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    learn = F.col("key").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    return train(plain.filter(~held_out(F.col("key")) & learn), config)


def tag_languages(
    docs: DataFrame, config: LangConfig = LangConfig(), key: str = "doc_id", text: str = "text", lang: str = "lang",
    predicted: str = "lang_pred", score: str = "lang_score",
) -> DataFrame:
    """``docs`` with all its columns and two more: the predicted language and its score."""
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    out = T.StructType([*fields, T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])
    tag = _tagger(_learned(docs, config, key, text, lang), docs.columns.index(text))
    return docs.toDF(*(f.name for f in fields)).mapInArrow(tag, out).toDF(*docs.columns, predicted, score)


def identify(docs: DataFrame, config: LangConfig = LangConfig(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row; learned from rows that are not held out."""
    model = _learned(docs, config, key, text, lang)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key), held_out(F.col(key)).alias("_held"), F.col(text).cast("string").alias("_text"))
    return out.mapInArrow(_predictor(model), f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
