"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a part ends at a word's end.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0xD1342543DE82EF95, 0x2545F4914F6CDD1D, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(1024)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each value; null is empty."""
    for x in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield x.as_py() or b""


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > PIECE:
        stop = at + PIECE
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, in order."""
    global _POWER
    out = []
    for part in _parts(data):
        raw = np.frombuffer(part, np.uint8)
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = ~_SPACE[raw]
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, end = edges[::2], edges[1::2]
        if not len(start):
            continue
        inside = word[1:-1]
        lengths = end - start
        if (longest := int(lengths.max())) > len(_POWER):
            _POWER = _powers(2 * longest)
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        out.append(mix(np.add.reduceat(_LOWER[raw[inside]] * _POWER[place], first) ^ lengths.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(data: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of word shingles; with fewer words, of the whole sequence."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(size, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        total += w[j : len(w) - k + 1 + j] * _PLACES[j % len(_PLACES)] + np.uint64(j)
    return np.unique(mix(total))
