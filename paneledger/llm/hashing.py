"""Hashes of words and shingles over whole Arrow batches of texts, in numpy.

A word's hash is a polynomial of its bytes (A-Z lower-cased) modulo 2**64, taken as
the difference of two prefix sums, then mixed. No word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SEEDS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWERED = np.arange(256, dtype=np.uint64)
_LOWERED[65:91] += 32
_LOWERED += 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << n.bit_length(), 2 * BLOCK_BYTES)
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of the rows ``first`` ... ``last`` - 1: word ``k`` is
    ``data[starts[k]:ends[k]]``, row ``first + r`` has ``offsets[r]`` ... ``offsets[r + 1]`` - 1."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        powers, inverses = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWERED[self.data] * powers[:n], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * inverses[self.starts])


def words_of(texts: pa.Array, block_bytes: int = BLOCK_BYTES, between: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts, in blocks of rows of about so many
    bytes (a longer text is a block of its own). ``between`` says which bytes part words. A
    null has no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
        yield _block(first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], between)
        first = last


def _block(first: int, last: int, data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> Words:
    n = len(data)
    space = between[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    rims = offsets[(offsets > 0) & (offsets < n)]
    before[rims], after[rims - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return Words(first, last, data, np.searchsorted(starts, offsets, "left"), starts, ends)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows ``first, last``: the hashes of their words in order, and the
    offsets that part them by row."""
    for words in words_of(texts):
        yield words.first, words.last, words.hashes(), words.offsets


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of ``size`` words; a
    text with fewer words is one shingle, a text without words has none."""
    for _, _, words, offsets in word_hashes(texts):
        n = max(0, len(words) - size + 1)
        shingles = np.zeros(n, np.uint64)
        for k in range(size):
            shingles += mixed(words[k:k + n] * _SEEDS[k % 5] + np.uint64(k))
        shingles = mixed(shingles)
        for start, end in zip(offsets[:-1], offsets[1:]):
            if end - start >= size:
                own = np.sort(shingles[start:end - size + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif end > start:
                seeded = words[start:end] * _SEEDS[:end - start] + np.arange(100, 100 + end - start, dtype=np.uint64)
                yield mixed(mixed(seeded).sum(keepdims=True) + np.uint64(end - start))
            else:
                yield np.zeros(0, np.uint64)
