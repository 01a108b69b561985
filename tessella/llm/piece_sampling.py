"""SentencePiece encoding and decoding with sampled segmentations, by Gumbel top-k without replacement.

All segmentations of a text into vocabulary pieces form a lattice. A piece of rank r has the weight
``p(r) ** alpha`` with p(r) proportional to ``1 / (r + 2)`` (a Zipf law over the merges' ranks, as the
model file has no probabilities), a segmentation the product, normalised over the lattice by forward sums. Each segmentation's log
probability gets Gumbel noise, and the ``samples`` best are emitted: a sample without replacement.

The noise is never drawn for all segmentations. A best-first (A*) search over perturbed bounds goes top
down: the best completion of a lattice state is drawn from the forward sums, which makes its bound exact;
all that was passed over at a word gets one bound, a Gumbel draw truncated at the bound it branched from.
The highest bound is expanded next. What is left in the queue gives the threshold for the inclusion
score, ``log(1 - exp(-exp(log_prob - threshold)))``.

Pieces never cross from a word into the next space, so the lattice is a chain of word lattices. Forward
sums of all distinct words of a batch, and draws for all words of all its texts, are numpy operations.
A word's lattice depends on nothing but the word, so that a worker keeps it for later texts, within a
bound; beyond it the words met most often stay. Draws are hashes of (row key, sample, word, step): equal rows get equal results on any cluster.

A character that is no piece is spelled in byte pieces, as is a literal U+2581. Decoding is exact.
The vocabulary's file is a parameter; the driver reads it once and ships the pieces.

Defined results: null and empty texts have one segmentation, without pieces; texts with fewer
segmentations than ``samples`` give all of them, with inclusion 1; a text of any length is encoded whole,
with some 60 bytes of memory for a word; repeated rows give repeated results; a null key is a key of its
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import lean

#: Characters handled at once; texts that are longer stand alone.
PIECE = 256 << 10
#: Words drawn at once, also of one text, however long it is.
BLOCK = 64 << 10
#: States of the lattices that a worker keeps for the next texts; beyond it, words met most often keep theirs.
KEPT_STATES = 512 << 10
#: New words whose lattices are made at once, so that their arrays stay in a core's cache.
NEW_WORDS = 4 << 10
#: Words up to this length are handled together; longer ones one by one in logarithms.
TOGETHER = 40
_CHUNK = re.compile(r" *[^ \n\t]+| +|[\n\t]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(44)


@dataclass(frozen=True)
class SampleConfig:
    model_file: str = "/opt/tokenizers/piece_bpe_32k.model"
    samples: int = 2
    alpha: float = 0.5
    seed: int = 3


@dataclass
class Vocabulary:
    pieces: list[str]  # text of each id, with a plain space for U+2581
    bytes_at: int  # id of byte 0
    ranks: np.ndarray
    alpha: float
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        plain = [(k, p) for k, p in enumerate(self.pieces) if p]
        self.longest = max(len(p) for _, p in plain)
        weight = -np.log(np.arange(len(self.pieces)) + 2.0)
        weight = self.alpha * (weight - np.log(np.exp(weight).sum()))
        keys = np.array([_string_hash(p) for _, p in plain], np.uint64)
        place = ((keys * _SPREAD) >> _SHIFT).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        # the first key of each bucket, and how many a bucket has at most
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[place[::-1]] = np.arange(len(place))[::-1]
        self.most = int(np.bincount(place).max())
        self.keys = np.append(keys[order], np.zeros(self.most, np.uint64))
        self.ids = np.append(np.array([k for k, _ in plain], np.int32)[order], np.zeros(self.most, np.int32))
        begins = {p[:n] for _, p in plain for n in range(1, len(p))}
        # of each bucket: 1 if it has a piece, 2 if one may begin there
        self.flags = (self.first >= 0).astype(np.uint8)
        self.flags[((np.array([_string_hash(p) for p in begins], np.uint64) * _SPREAD) >> _SHIFT).astype(np.int64)] |= 2
        self.weights = weight[self.ranks]
        self.chances = np.exp(self.weights)
        self.byte_weight = float(weight[-1])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashed strings are pieces, their ids, and which may begin a longer piece."""
        bucket = ((h * _SPREAD) >> _SHIFT).view(np.int64)
        flags = self.flags[bucket]
        maybe = np.flatnonzero(flags & 1)
        at, own = self.first[bucket[maybe]], h[maybe]
        other = np.flatnonzero(self.keys[at] != own)
        for _ in range(1, self.most):
            # only what its place does not hold moves to the next one
            at[other] += 1
            other = other[self.keys[at[other]] != own[other]]
        hit = np.ones(len(maybe), bool)
        hit[other] = False
        return maybe[hit], self.ids[at[hit]], np.flatnonzero(flags & 2)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))  # the caller's array stays; the rest is in place
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _string_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) % 2**64
    return h


def load_vocabulary(config: SampleConfig = SampleConfig()) -> Vocabulary:
    """Pieces of a model file whose pieces have spaces only at their start (or are nothing else)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=config.model_file)
    pieces, scores, bytes_at = [], [], 0
    for k in range(model.get_piece_size()):
        special = model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
        if model.is_byte(k) and model.id_to_piece(k) == "<0x00>":
            bytes_at = k
        pieces.append("" if special else model.id_to_piece(k).replace("▁", " "))
        scores.append(model.get_score(k))
    if any(" " in p.lstrip(" ") or re.search(r"[\n\t]", p) and len(p) > 1 for p in pieces):
        raise ValueError("a piece of this model crosses words")
    ranks = np.empty(len(pieces), np.int64)
    ranks[np.lexsort((np.arange(len(pieces)), -np.array(scores)))] = np.arange(len(pieces))
    return Vocabulary(pieces, bytes_at, ranks, config.alpha)


@dataclass
class Words:
    """Lattices of distinct words, end to end; state ``base[w] + j`` comes after j characters.

    The pieces that end in a state are its edges ``first[state]`` to ``first[state + 1]``."""

    base: np.ndarray
    length: np.ndarray
    first: np.ndarray
    size: np.ndarray  # of edges: characters of the piece
    ids: np.ndarray  # of edges: the piece, or -1 for a character in bytes
    chance: np.ndarray  # of edges: probability of being the last piece of what ends in the state
    cdf: np.ndarray  # of edges: running probability within the state; the last is one
    end: np.ndarray  # of edges: the state
    chars: np.ndarray  # the character before each state


def word_lattices(words: list[str], v: Vocabulary) -> Words:
    length = np.fromiter(map(len, words), np.int64, len(words))
    base = np.cumsum(length + 1) - (length + 1)
    total = int((length + 1).sum())
    chars = np.zeros(total, np.uint64)
    inside = np.ones(total, bool)
    inside[base] = False  # state 0 of each word
    chars[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(total) - np.repeat(base, length + 1)  # characters before each state
    ends, sizes, ids = [], [], []
    left = np.repeat(length, length + 1) - place  # characters after each state
    step, starts, h = chars + np.uint64(1), np.flatnonzero(left), None
    for n in range(1, min(v.longest, int(length.max(initial=0))) + 1):
        # the states with n characters of their word after them, and the hashes of these
        if n > 1:
            inner = np.flatnonzero(left[starts] >= n)
            starts, h = starts[inner], h[inner] * _BASE
            h += step[starts + n]
        else:
            h = step[starts + 1]
        hit, piece, longer = v.find(h)
        end = starts[hit] + n
        starts, h = starts[longer], h[longer]
        if n == 1:  # a character that is no piece goes in bytes
            alone = np.ones(total, bool)
            alone[end] = False
            odd = np.flatnonzero(alone & inside)
            end, piece = np.append(end, odd), np.append(piece, np.full(len(odd), -1, np.int32))
        ends.append(end)
        sizes.append(np.full(len(end), n, np.int64))
        ids.append(piece)
    end, size, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ends, sizes, ids))
    order = np.argsort(end.astype(np.uint16) if total <= 1 << 16 else end, kind="stable")  # 16 bits sort by digits
    end, size, piece = end[order], size[order], piece[order].astype(np.int32)
    first = np.zeros(total + 1, np.int64)
    np.cumsum(np.bincount(end, minlength=total), out=first[1:])
    odd = np.flatnonzero(piece < 0)
    c = chars[end[odd]]
    spelled = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4))) * v.byte_weight
    chance, state = v.chances[piece], np.zeros(total)
    chance[odd] = np.exp(spelled)
    state[base] = 1.0
    # edges of short words by the place of their state; places of long words count as beyond
    turn = np.where(np.repeat(length <= TOGETHER, length + 1), place, TOGETHER + 1).astype(np.int16)[end]
    turns = np.argsort(turn, kind="stable")
    bounds = np.searchsorted(turn[turns], np.arange(1, TOGETHER + 2))
    turns = turns[: bounds[-1]]
    # in this order: where the edges begin, the runs of edges with one end, and which runs a place has
    into, part = end[turns], chance[turns]
    begin = into - size[turns]
    runs = np.flatnonzero(np.append(True, into[1:] != into[:-1])) if len(into) else turns
    many, into, of_place = np.diff(np.append(runs, len(into))), into[runs], np.searchsorted(runs, bounds)
    for a, b, r, q in zip(bounds[:-1], bounds[1:], of_place[:-1], of_place[1:], strict=True):
        if a == b:
            break
        mass = state[begin[a:b]] * part[a:b]
        sums = np.add.reduceat(mass, runs[r:q] - a)
        state[into[r:q]] = sums
        part[a:b] = mass / np.repeat(sums, many[r:q])
    chance[turns] = part
    beyond = np.flatnonzero(length > TOGETHER)
    if len(beyond):
        weight = v.weights[piece]
        weight[odd] = spelled
    for w in beyond:
        logs = np.zeros(length[w] + 1)
        for j in range(1, length[w] + 1):
            e = slice(first[base[w] + j], first[base[w] + j + 1])
            part = logs[j - size[e]] + weight[e]
            mass = np.exp(part - part.max())
            logs[j] = part.max() + np.log(mass.sum())
            chance[e] = mass / mass.sum()
    # running sums within each state, so that they don't depend on what else is in the batch
    cdf, edges = chance.copy(), np.diff(first)
    more = np.flatnonzero(edges > 1)
    for k in range(1, int(edges.max(initial=1))):
        at = first[more] + k
        cdf[at] += cdf[at - 1]
        more = more[edges[more] > k + 1]
    cdf[first[1:][edges > 0] - 1] = 1.0
    return Words(base, length, first, size.astype(np.int32), piece, chance, cdf, end.astype(np.int32), chars.astype(np.uint32))


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first[k]`` to ``first[k] + count[k] - 1`` of each k, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


class Lattices:
    """Lattices of the words a worker has met, by their numbers."""

    def __init__(self, v: Vocabulary, most_states: int = KEPT_STATES):
        self.v, self.most_states, self.number, self.words = v, most_states, {}, word_lattices([], v)
        self.used = np.empty(0, np.int64)  # how often each word was met
        self.room: dict[str, np.ndarray] = {}

    def _add(self, b: Words) -> None:
        """Puts the lattices of ``b`` after the others, in arrays that grow by half."""
        states, edges, grown = len(self.words.chars), len(self.words.ids), {}
        shifted = {"base": b.base + states, "first": b.first[1:] + edges, "end": b.end + np.int32(states)}
        for k, old in vars(self.words).items():
            new = shifted.get(k, getattr(b, k))
            n = len(old) + len(new)
            if k not in self.room or len(self.room[k]) < n:
                self.room[k] = np.empty(n + n // 2, new.dtype)
                self.room[k][: len(old)] = old
            self.room[k][len(old) : n] = new
            grown[k] = self.room[k][:n]
        self.words = Words(**grown)

    def _thin(self) -> None:
        """Keeps the words met most often, of those met more than once, in half of the states."""
        w, states = self.words, self.words.length + 1
        order = np.argsort(-self.used, kind="stable")
        order = order[: np.count_nonzero((np.cumsum(states[order]) <= self.most_states // 2) & (self.used[order] > 1))]
        kept = np.zeros(len(states), bool)
        kept[order] = True
        at = np.flatnonzero(kept)
        names = list(self.number)  # in the order of their numbers
        self.number = {names[k]: n for n, k in enumerate(at.tolist())}
        self.used = self.used[at] // 2  # what was met long ago counts less
        base, states = w.base[at], states[at]
        from_edge = w.first[base]
        edges = w.first[base + states] - from_edge
        of_state, of_edge = _spans(base, states), _spans(from_edge, edges)
        moved = np.cumsum(states) - states
        first = np.append(0, np.cumsum(np.diff(w.first)[of_state]))
        end = w.end[of_edge] + np.repeat(moved - base, edges).astype(np.int32)
        kept_edges = {k: getattr(w, k)[of_edge] for k in ("size", "ids", "chance", "cdf")}
        self.words = Words(base=moved, length=w.length[at], first=first, end=end, chars=w.chars[of_state], **kept_edges)
        for k, x in vars(self.words).items():
            self.room[k][: len(x)] = x
        self.words = Words(**{k: self.room[k][: len(x)] for k, x in vars(self.words).items()})

    def numbers(self, words: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Numbers of ``words``, each met so many ``times`` (once), in ``self.words``; they hold until the next call."""
        if len(self.words.chars) > self.most_states:
            self._thin()
        out = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            named = list(map(words.__getitem__, missing.tolist()))
            fresh = list(dict.fromkeys(named))
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
            for k in range(0, len(fresh), NEW_WORDS):
                self._add(word_lattices(fresh[k : k + NEW_WORDS], self.v))
            out[missing] = np.fromiter(map(self.number.__getitem__, named), np.int64, len(named))
        met = np.bincount(out, times, len(self.number)).astype(np.int64)
        met[: len(self.used)] += self.used
        self.used = met
        return out


def _mixed(seeds: np.ndarray, *parts) -> np.ndarray:
    h = seeds.astype(np.uint64)
    for p in parts:
        h = _scramble((h ^ np.asarray(p).astype(np.uint64)) * _BASE + np.uint64(0x632BE59BD9B4E019))
    return h


def _uniform(seeds: np.ndarray, *parts) -> np.ndarray:
    return ((_mixed(seeds, *parts) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def draw_words(w: Words, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A segmentation of each word from its distribution: log probabilities, and steps from the words'
    ends backwards as (places in ``which``, edges)."""
    logs, begin = np.zeros(len(which)), w.base[which]
    at, state, steps = np.arange(len(which)), begin + w.length[which], []
    more = np.flatnonzero(state > begin)
    while len(more):
        if len(more) < len(at):
            at, state, begin, seeds = at[more], state[more], begin[more], seeds[more]
        edge, u = w.first[state], _uniform(seeds, len(steps))
        later = np.flatnonzero(w.cdf[edge] <= u)
        e, u = edge[later], u[later]
        while len(later):
            e += 1
            edge[later] = e
            on = np.flatnonzero(w.cdf[e] <= u)
            later, e, u = later[on], e[on], u[on]
        logs[at] += np.log(w.chance[edge])
        steps.append((at, edge))
        state = state - w.size[edge]
        more = np.flatnonzero(state > begin)
    return logs, steps


def in_order(count: int, steps) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each word, its edges in reading order)."""
    n = np.zeros(count, np.int64)
    for at, _ in steps:
        n[at] += 1
    ends = np.cumsum(n)
    edges = np.empty(int(n.sum()), np.int32)
    for k, (at, e) in enumerate(steps):
        edges[ends[at] - (k + 1)] = e
    return np.append(0, ends), edges


def draw_other(w: Words, word: int, gone: list[tuple[int, ...]], uniforms: Iterator[float]) -> tuple[tuple[int, ...], float]:
    """A segmentation of ``word`` other than those in ``gone`` (edges from the end backwards), from the
    distribution given that, and its unconditional log probability."""
    state, path, log = int(w.base[word] + w.length[word]), [], 0.0
    while state > w.base[word]:
        lo, hi = int(w.first[state]), int(w.first[state + 1])
        mass = w.chance[lo:hi].tolist()
        left = list(mass)
        for seg in gone:
            p = 1.0
            for e in seg:
                p *= float(w.chance[e])
            left[seg[0] - lo] -= p
        # differences of nearly equal sums: what has only excluded paths below it stays excluded
        left = [x if x >= 1e-15 else 0.0 for x in left]
        if not any(left):
            return (), -np.inf
        u, k = next(uniforms) * sum(left), 0
        while k < len(left) - 1 and (u >= left[k] or not left[k]):
            u -= left[k]
            k += 1
        while not left[k]:  # rounding at the end of the sums
            k -= 1
        path.append(lo + k)
        log += float(np.log(mass[k]))
        gone = [seg[1:] for seg in gone if seg[0] == lo + k and len(seg) > 1]
        state -= int(w.size[lo + k])
    return tuple(path), log


def _below(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws with location ``phi``, given that they are at most ``top``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(u))
    return np.where(np.isfinite(phi), out, -np.inf)


def _log_rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - p); minus infinity where p is one up to rounding."""
    with np.errstate(divide="ignore"):
        rest = -np.expm1(np.minimum(log_p, 0.0))
        return np.where(rest > 1e-13, np.log(rest), -np.inf)


@dataclass
class _Path:
    edges: np.ndarray  # in reading order
    first: np.ndarray  # offset of each word's edges
    logs: np.ndarray  # of each word
    bound: float  # its perturbed log probability
    queue: np.ndarray  # bounds of what was passed over at each word
    branch: int = 0
    gone: tuple[tuple[int, ...], ...] = ()  # segmentations of word ``branch`` that are out already

    def word(self, i: int) -> tuple[int, ...]:
        return tuple(self.edges[self.first[i] : self.first[i + 1]][::-1].tolist())


def sample_texts(
    keys: list[int], chunks: list[list[str]], v: Vocabulary, config: SampleConfig, lattices: Lattices | None = None
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text (as chunks) its samples as (ids, log_prob, perturbed, log_inclusion), best first.
    ``lattices`` are those of words met before."""
    lattices = lattices or Lattices(v)
    flat = lattices.numbers(list(chain.from_iterable(chunks)))
    return sample_numbered(keys, flat, np.array([len(c) for c in chunks], np.int64), lattices.words, v, config)


def sample_numbered(
    keys: list, flat: np.ndarray, counts: np.ndarray, w: Words, v: Vocabulary, config: SampleConfig
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """``sample_texts`` of texts with ``counts`` words each, which are the numbers ``flat`` in ``w``."""
    ends = np.cumsum(counts)
    starts = ends - counts
    seeds = np.array([xxhash.xxh3_64_intdigest(str(k).encode(), seed=config.seed) for k in keys], np.uint64)
    def tails(jobs: list[tuple[int, int, float, float]], sample: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Draws of (text, from word, log probability before it, bound) each: logs, first, edges of the words
        from there, and the bounds of what was passed over at each word."""
        text, skip = (np.array([x[k] for x in jobs], np.int64) for k in (0, 1))
        before, bound = (np.array([x[k] for x in jobs], np.float64) for k in (2, 3))
        lengths = counts[text] - skip
        at, stops = _spans(starts[text] + skip, lengths), np.cumsum(lengths)
        job = np.repeat(np.arange(len(jobs), dtype=np.int32), lengths)
        # what a word's draws share with those of all words of its text is hashed once
        turn, apart = _turned(seeds[text], np.uint64(sample)), _mixed(seeds[text], 1 << 40, sample)
        logs, n, u, edges = np.empty(len(at)), np.empty(len(at), np.int64), np.empty(len(at)), []
        for k in range(0, len(at), BLOCK):
            block, own = at[k : k + BLOCK], job[k : k + BLOCK]
            place = (block - starts[text][own]).astype(np.uint64)
            logs[k : k + BLOCK], steps = draw_words(w, flat[block], _placed(turn[own], place))
            first, found = in_order(len(block), steps)
            n[k : k + BLOCK] = np.diff(first)
            u[k : k + BLOCK] = _uniform(apart[own], place)
            edges.append(found)
        edges = np.concatenate(edges) if edges else np.empty(0, np.int32)
        first, queue = np.append(0, np.cumsum(n)), np.empty(len(at))
        for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True):
            np.cumsum(logs[a:b], out=queue[a:b])  # of each text apart, so that sums don't depend on the batch
        for k in range(0, len(at), BLOCK):
            own, part = slice(k, k + BLOCK), job[k : k + BLOCK]
            queue[own] = _below(before[part] + queue[own] - logs[own] + _log_rest(logs[own]), bound[part], u[own])
        for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True):
            yield logs[a:b], first[a : b + 1] - first[a], edges[first[a] : first[b]], queue[a:b]

    paths: list[list[_Path]] = []
    bounds = (-np.log(-np.log(_uniform(seeds, 1 << 41)))).tolist()
    for bound, (logs, first, edges, queue) in zip(bounds, tails([(t, 0, 0.0, b) for t, b in enumerate(bounds)], 0), strict=True):
        paths.append([_Path(edges, first, logs, bound, queue)])
    for sample in range(1, config.samples):
        jobs, fresh = [], []
        others, rest_of = _mixed(seeds, 1 << 42, sample), _uniform(seeds, 1 << 43, sample)
        for t, own in enumerate(paths):
            if len(own) < sample or not counts[t]:
                continue
            p = max(own, key=lambda x: x.queue.max())
            i = int(p.queue.argmax())
            bound = float(p.queue[i])
            if not np.isfinite(bound):
                continue
            gone = (p.word(i), *(p.gone if i == p.branch else ()))
            word = int(flat[starts[t] + i])
            uniforms = iter(_uniform(others[t : t + 1], np.arange(w.length[word])).tolist())
            seg, log = draw_other(w, word, list(gone), uniforms)
            p.queue[i] = -np.inf
            if not seg:
                continue
            before = float(p.logs[:i].sum())
            jobs.append((t, i + 1, before + log, bound))
            fresh.append((p, i, before, gone, seg, log))
        for (t, _, _, bound), (p, i, before, gone, seg, log), (logs, first, edges, queue) in zip(jobs, fresh, tails(jobs, sample), strict=True):
            head = p.first[i]
            out = sum(float(w.chance[list(g)].prod()) for g in gone) + np.exp(log)
            here = _below(np.array([before + (np.log(1 - out) if 1 - out > 1e-13 else -np.inf)]), np.array([bound]), rest_of[t : t + 1])
            paths[t].append(
                _Path(
                    np.concatenate([p.edges[:head], seg[::-1], edges]).astype(np.int32), np.concatenate([p.first[: i + 1], first + head + len(seg)]),
                    np.concatenate([p.logs[:i], [log], logs]), bound, np.concatenate([np.full(i, -np.inf), here, queue]), i, gone,
                )
            )
    every = [p.edges for own in paths for p in own]
    ids, cuts = _ids(w, np.concatenate(every) if every else np.empty(0, np.int32), np.append(0, np.cumsum([len(e) for e in every], dtype=np.int64)), v)
    spans = iter(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    results = []
    for own in paths:
        limit = max((float(p.queue.max(initial=-np.inf)) for p in own), default=-np.inf)
        row = []
        for p in own:
            log = float(p.logs.sum())
            x = log - limit
            row.append((ids[slice(*next(spans))], log, p.bound, 0.0 if not np.isfinite(limit) else x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700)))))))
        results.append(row)
    return results


def _turned(seeds: np.ndarray, turn: np.uint64) -> np.ndarray:
    return _scramble((seeds ^ turn) * _BASE + np.uint64(1))


def _placed(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    return _scramble((h ^ place) * _BASE + np.uint64(2))


def _ids(w: Words, edges: np.ndarray, cuts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``edges``, and where those of the edges before each of ``cuts`` end."""
    ids = w.ids[edges]
    spelled = np.flatnonzero(ids < 0)
    if len(spelled):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in w.chars[w.end[edges[spelled]]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[spelled] = [len(x) for x in raw]
        cuts = np.append(0, np.cumsum(times))[cuts]
        ids = np.repeat(ids, times)
        ids[ids < 0] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + v.bytes_at
    return ids, cuts


def chunked(text: str) -> list[str]:
    """Parts of a text, after one leading space, that no piece crosses."""
    if not text:
        return []
    text = " " + text
    if "  " in text or "\0" in text:
        return _CHUNK.findall(text)
    # the same where no spaces follow each other: cut before spaces and around line ends and tabs
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace("\t", "\0\t\0")
    return list(filter(None, cut.split("\0")))


def _cut(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """``chunked`` of all texts: numbers of their parts, the distinct parts, and how many parts each text has."""
    plain = texts.fill_null("")
    if pc.any(pc.match_substring(plain, "\0")).as_py():
        parts = list(map(chunked, plain.to_pylist()))
        values, counts = pa.array(list(chain.from_iterable(parts)), pa.string()), np.array([len(p) for p in parts], np.int64)
    else:
        cut = plain
        for a, b in ((" ", "\0 "), ("\n", "\0\n\0"), ("\t", "\0\t\0")):
            cut = pc.replace_substring(cut, a, b)
        cut = pc.binary_join_element_wise(" ", cut, "")
        # spaces that follow each other, also the one before each text, belong together
        odd = pc.or_(pc.match_substring(plain, "  "), pc.or_(pc.starts_with(plain, " "), pc.equal(plain, "")))
        if pc.any(odd).as_py():
            cut = pc.replace_with_mask(cut, odd, pa.array(["\0".join(chunked(t)) for t in plain.filter(odd).to_pylist()], pa.string()))
        lists = pc.split_pattern(cut, "\0")
        values = lists.flatten()
        some = pc.binary_length(values).to_numpy() > 0
        counts = np.diff(np.append(0, np.cumsum(some))[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        values = values.filter(pa.array(some))
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), counts  # to_pylist takes ten times as long


def _spelled(pieces: list[str], bytes_at: int) -> list[bytes]:
    """The bytes that each id stands for."""
    out = [p.encode("utf-8", "surrogatepass") for p in pieces]
    out[bytes_at : bytes_at + 256] = [bytes([k]) for k in range(256)]
    return out


def _text(ids, spelled: list[bytes]) -> str:
    """The text of piece ids, without the space that every text has before it."""
    return b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def decode_ids(ids, pieces: list[str], bytes_at: int) -> str:
    """The text of piece ids."""
    return _text(ids, _spelled(pieces, bytes_at))


def _encoder(v: Vocabulary, config: SampleConfig):
    def run(batches):
        lattices = Lattices(v)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            start, sizes = 0, pc.utf8_length(texts).fill_null(0).to_pylist()
            while start < len(keys):
                chars, stop = 0, start
                while stop < len(keys) and (chars < PIECE or stop == start):
                    chars, stop = chars + sizes[stop], stop + 1
                codes, words, counts = _cut(texts.slice(start, stop - start))
                numbers = lattices.numbers(words, np.bincount(codes, minlength=len(words)))
                got = sample_numbered(keys[start:stop], numbers[codes], counts, lattices.words, v, config)
                at = [k for k, rows in enumerate(got, start) for _ in rows]
                flat = [x for rows in got for x in rows]
                pieces = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum([len(x[0]) for x in flat])), pa.int32()), pa.array(np.concatenate([x[0] for x in flat]), pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.take(pa.array(at, pa.int64())) for k, c in enumerate(batch.columns) if k != 1),
                        pa.array([k for rows in got for k in range(len(rows))], pa.int32()),
                        pieces,
                        *(pa.array([x[k] for x in flat], pa.float64()) for k in (1, 2, 3)),
                    ],
                    names=[batch.schema.names[0], *batch.schema.names[2:], "sample", "ids", "log_prob", "perturbed", "log_inclusion"],
                )
                start = stop

    return run


_SAMPLED = "sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


def encode(docs: DataFrame, config: SampleConfig = SampleConfig(), key: str = "doc_id", text: str = "text", with_digest: bool = False) -> DataFrame:
    """(key, sample, ids, log_prob, perturbed, log_inclusion): up to ``samples`` rows for each row;
    ``with_digest`` adds text_sha256 of the text (null: empty) after the key."""
    kind = docs.schema[key].dataType.simpleString()
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    extra = [F.sha2(plain.cast("binary"), 256).alias("text_sha256")] if with_digest else []
    schema = f"`{key}` {kind}, " + ("text_sha256 string, " if with_digest else "") + _SAMPLED
    return lean(docs).select(F.col(key), plain.alias("_text"), *extra).mapInArrow(_encoder(load_vocabulary(config), config), schema)


def _decoder(spelled: list[bytes], at: int):
    table = pa.array(spelled, pa.large_binary())

    def run(batches):
        for batch in batches:
            ids = batch.column(at)
            # the spellings of a batch's ids lie end to end, so a text is a slice of them
            bounds = ids.offsets.to_numpy().astype(np.int64)
            joined = table.take(ids.values[bounds[0] : bounds[-1]])
            ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][bounds - bounds[0]] if len(joined) else np.zeros(len(bounds), np.int64)
            # each text has a space before it, which goes
            data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[int(ends[0]) : int(ends[-1])]
            some = np.diff(ends) > 0
            kept = np.ones(len(data), bool)
            kept[(ends[:-1] - ends[0])[some]] = False
            ends = ends - ends[0] - np.append(0, np.cumsum(some))
            nulls = ids.is_valid().buffers()[1] if ids.null_count else None
            texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[kept].tobytes()), nulls)
            texts = texts.cast(pa.string())
            texts.validate(full=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, config: SampleConfig = SampleConfig(), ids: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids in a column ``decoded``; null ids decode to null."""
    v = load_vocabulary(config)
    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(_decoder(_spelled(v.pieces, v.bytes_at), encoded.columns.index(ids)), schema)
