"""Hashed word shingles of text batches, worked out on whole Arrow buffers.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's hash is a polynomial
over its bytes with random coefficients, taken from running sums, so no word becomes an object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CHUNK_BYTES = 1 << 20
_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
EXACT = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUES = EXACT[_LOWER]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer chunk comes along."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def up_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            up, down = _powers(_BASE, n), _powers(_INVERSE, n)
            if n > 8 * _CHUNK_BYTES:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_powers_seen = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` of a fixed odd number and of its inverse, modulo 2^64."""
    return _powers_seen.up_to(n)


def word_hashes(data: np.ndarray, bounds: np.ndarray, values: np.ndarray = _BYTE_VALUES, with_starts: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, number of words before each bound) for texts that lie at ``bounds``, and where words start if asked for."""
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]]) if len(data) else np.zeros(0, dtype=bool)
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = True
    after = np.concatenate([blank[1:], [True]]) if len(data) else before
    after[inner - 1] = True
    starts, stops = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    up, down = powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * up[:len(data)])])
    hashes = mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    before = np.searchsorted(starts, bounds)
    return (hashes, before, starts) if with_starts else (hashes, before)


def _fold(words: np.ndarray, k: int, places: np.ndarray) -> np.ndarray:
    """Hash of the ``k`` words from each place on."""
    h = np.full(len(places), np.uint64(k), dtype=np.uint64)
    for j in range(k):
        h = mixed(h * _BASE + words[places + j])
    return h


def chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds of the texts in them) for runs of texts of about a megabyte; NULL is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK_BYTES, side="right")) - 1)
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text in turn.

    A text of fewer words is one shingle, one without words or NULL has none.
    """
    for data, bounds in chunks(column):
        words, counts = word_hashes(data, bounds)
        full = _fold(words, k, np.arange(max(0, len(words) - k + 1)))
        for a, b in zip(counts, counts[1:]):
            if b - a >= k:
                yield np.unique(full[a:b - k + 1])
            else:
                yield _fold(words, b - a, np.array([a])) if b > a else np.zeros(0, dtype=np.uint64)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on that has as many, from running sums."""
    n = max(0, len(words) - k + 1)
    up, down = powers(len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words) * up[:len(words)])])
    return mixed((sums[k:k + n] - sums[:n]) * down[:n] + np.uint64(k))
