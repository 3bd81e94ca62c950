"""Hashes of words and of word sequences, vectorised over blocks of documents.

Words are `[^\\x20\\x09-\\x0D]+`, which is what bytes.split() cuts. A sequence's hash is a polynomial in its words' 64-bit hashes
modulo 2**64, read off prefix sums, and mixed: any span costs the same, whatever its length.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_SIZE = 0xD6E8FEB86659FD93
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        p = np.full(max(n, 1 << 18), base, np.uint64)
        p[0] = 1
        _tables[base] = np.multiply.accumulate(p)
    return _tables[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``most`` words."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash(word)
        return h


_hashes: WordHashes | None = None


def hashed(words: list[bytes]) -> np.ndarray:
    global _hashes
    if _hashes is None:
        _hashes = WordHashes()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


class Spans:
    """Hashes of any spans of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((h | np.uint64(1)) * powers(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + size * np.uint64(_SIZE))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n] + np.uint64(size * _SIZE % (1 << 64)))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x
