from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import piece_sampling
from tessella.llm.piece_sampling import _CHUNK, Lattices, SampleConfig, _decoder, _spelled, chunked, decode, decode_ids, encode, load_vocabulary, sample_texts, word_lattices

CONFIG = SampleConfig(samples=3)
V = load_vocabulary(CONFIG)
PIECES = {p: k for k, p in enumerate(V.pieces) if p}


def all_segmentations(text: str) -> dict[tuple[int, ...], float]:
    """Ids of every segmentation, and its weight."""
    text = " " + text
    found: list[dict[tuple[int, ...], float]] = [{(): 1.0}]
    for j in range(1, len(text) + 1):
        here: dict[tuple[int, ...], float] = {}
        for i in range(j):
            part = text[i:j]
            if part in PIECES:
                k = PIECES[part]
                edge, weight = (k,), float(np.exp(V.weights[k]))
            elif j == i + 1:
                raw = part.encode()
                edge, weight = tuple(V.bytes_at + b for b in raw), float(np.exp(V.byte_weight)) ** len(raw)
            else:
                continue
            for path, p in found[i].items():
                here[path + edge] = here.get(path + edge, 0.0) + p * weight
        found.append(here)
    total = sum(found[-1].values())
    return {k: p / total for k, p in found[-1].items()}


def test_probabilities_and_distinct_samples():
    for text in ("the cat", "ab  c", "x\ny", "🙂 ▁a", "aé日"):
        every = all_segmentations(text)
        for row in sample_texts(list(range(40)), [chunked(text)] * 40, V, CONFIG):
            assert len({tuple(x[0]) for x in row}) == len(row) == min(3, len(every))
            for ids, log, *_ in row:
                assert abs(log - np.log(every[tuple(ids)])) < 1e-6
            assert [x[2] for x in row] == sorted((x[2] for x in row), reverse=True)


def test_pairs_are_drawn_without_replacement():
    text, n = "he it", 6000
    every = all_segmentations(text)
    config = SampleConfig(samples=2)
    got = Counter(tuple(tuple(x[0]) for x in row) for row in sample_texts(list(range(n)), [chunked(text)] * n, V, config))
    assert len(every) > 6
    for a, b in permutations(every, 2):
        p = every[a] * every[b] / (1 - every[a])
        assert abs(got[a, b] - n * p) < 5 * np.sqrt(n * p + 1)


def test_inclusion_scores_make_unbiased_sums():
    n = 6000
    flat = SampleConfig(samples=3, alpha=0.05)
    rows = sample_texts(list(range(n)), [chunked("he it")] * n, load_vocabulary(flat), flat)
    # each sample's probability over its inclusion probability: these sum to one on average
    sums = [sum(np.exp(x[1] - x[3]) for x in row) for row in rows]
    assert abs(np.mean(sums) - 1) < 5 * np.std(sums) / np.sqrt(n)
    assert np.std(sums) > 0.01


def test_few_segmentations_and_empty():
    (row,) = sample_texts([1], [chunked("")], V, CONFIG)
    assert [(list(x[0]), x[1], x[3]) for x in row] == [([], 0.0, 0.0)]
    (row,) = sample_texts([1], [chunked("🙂")], V, CONFIG)
    assert len(row) == len(all_segmentations("🙂"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60).filter(lambda t: t.isprintable() or True), max_size=5))
def test_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for text, row in zip(texts, sample_texts(list(range(len(texts))), [chunked(t) for t in texts], V, CONFIG), strict=True):
        for ids, *_ in row:
            assert decode_ids(ids, V.pieces, V.bytes_at) == text


def test_long_words_and_batches_do_not_matter():
    texts = ["a" * 5000 + "é" * 50, "short one", "word " * 3000]
    apart = [sample_texts([k], [chunked(t)], V, CONFIG)[0] for k, t in enumerate(texts)]
    for a, b in zip(apart, sample_texts([0, 1, 2], [chunked(t) for t in texts], V, CONFIG), strict=True):
        assert [list(x[0]) for x in a] == [list(x[0]) for x in b]
    for text, row in zip(texts, apart, strict=True):
        assert all(decode_ids(x[0], V.pieces, V.bytes_at) == text for x in row) and len(row) == 3


def test_rows(spark):
    rows = [(1, "Hello  world\r\n\tx", 0), (None, "Hello", 0), (2, None, 0), (3, "", 0), (4, "twin twin", 0), (4, "twin twin", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sample int")
    got = decode(encode(docs, CONFIG, with_digest=True), CONFIG).collect()
    assert {(r["doc_id"], r["decoded"]) for r in got} == {(k, t or "") for k, t, _ in rows}
    assert Counter(r["doc_id"] for r in got) == {1: 3, None: 3, 2: 1, 3: 1, 4: 6}
    assert encode(docs.limit(0)).count() == 0


def test_kept_lattices_do_not_matter():
    texts = [" ".join(f"{w}{k % 7}" for w in ("alpha", "beta", "gamma", f"rare{k}")) for k in range(40)]
    few = Lattices(V, 200)
    for k, t in enumerate(texts):
        (a,), (b,) = sample_texts([k], [chunked(t)], V, CONFIG), sample_texts([k], [chunked(t)], V, CONFIG, few)
        assert [(list(x[0]), *x[1:]) for x in a] == [(list(x[0]), *x[1:]) for x in b]
    assert 0 < len(few.number) < len({c for t in texts for c in chunked(t)})  # it started anew
    assert len(few.words.chars) == sum(len(w) + 1 for w in few.number)


def test_decoder_handles_nulls_slices_and_no_rows():
    spelled, ids = _spelled(V.pieces, V.bytes_at), sample_texts([1], [chunked("two words")], V, CONFIG)[0][0][0].tolist()
    whole = pa.RecordBatch.from_arrays([pa.array([None, [], ids, None, ids], pa.list_(pa.int32()))], names=["ids"])
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.list_(pa.int32()))], names=["ids"])
    got = [b.column("decoded").to_pylist() for b in _decoder(spelled, 0)([whole, whole.slice(2, 2), whole.slice(0, 1), empty])]
    assert got == [[None, "", "two words", None, "two words"], ["two words", None], [None], []]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\té", max_size=20))
def test_chunks_are_those_of_the_pattern(text):
    assert chunked(text) == (_CHUNK.findall(" " + text) if text else [])
    assert chunked(text + "\0") == _CHUNK.findall(" " + text + "\0")


def test_chances_of_pieces_are_computed_once(monkeypatch):
    """Lattices take the chances of pieces from the vocabulary; only characters in bytes need their own."""
    exp, done = np.exp, []
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: (done.append(np.size(x)), exp(x, *a, **k))[1])
    w = word_lattices([" segmentation", "ångström", " \u2581x", "a"], V)
    assert sum(done) == (w.ids < 0).sum() < len(w.ids)


def test_frequent_words_stay_when_lattices_are_too_many(monkeypatch):
    """Words of every text are built once, however many rare ones fill the room between."""
    built, make = Counter(), piece_sampling.word_lattices
    monkeypatch.setattr(piece_sampling, "word_lattices", lambda words, v: (built.update(words), make(words, v))[1])
    few, common = Lattices(V, 400), ["common", " words", " stay", "\n"]
    for k in range(60):
        few.numbers([*common, *(f" rare{k}x{n}é" for n in range(10)), *common])
    assert {built[c] for c in common} == {1}
    for word, n in few.number.items():  # those that moved are as when they are new
        one, w, at = make([word], V), few.words, few.words.base[n]
        edges = slice(w.first[at], w.first[at + len(word) + 1])
        assert w.length[n] == len(word) and (w.chars[at : at + len(word) + 1] == one.chars).all()
        assert (w.first[at : at + len(word) + 2] - w.first[at] == one.first).all() and (w.end[edges] - at == one.end).all()
        assert all((getattr(w, k)[edges] == getattr(one, k)).all() for k in ("size", "ids", "chance", "cdf"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té🙂", max_size=20) | st.none() | st.just("a\0 b"), max_size=5))
def test_columns_are_cut_like_texts(texts):
    for column in (pa.array(texts, pa.string()), pa.array(["x y", *texts], pa.string()).slice(1)):
        codes, words, counts = piece_sampling._cut(column)
        every = [chunked(t or "") for t in texts]
        assert counts.tolist() == list(map(len, every)) and len(set(words)) == len(words)
        assert [words[k] for k in codes] == [c for chunks in every for c in chunks]
