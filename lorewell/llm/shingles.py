"""Hashes of words and of runs of consecutive words, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of a worker's cache of word hashes.
CACHE = 100_000
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def rolling(h: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of k hashes, in log k steps; empty if there are fewer than k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, width, size, runs = None, 0, 1, h  # out: runs of `width`; runs: runs of `size`
    while True:
        if k & size:
            out = runs if out is None else _join(out, runs, width, size, base)
            width += size
        if size * 2 > k:
            return out
        runs = _join(runs, runs, size, size, base)
        size *= 2


def _join(first: np.ndarray, second: np.ndarray, width: int, size: int, base: int) -> np.ndarray:
    """Runs of ``width``, each followed by a run of ``size``."""
    n = len(second) - width
    return first[:n] * np.uint64(pow(base, size, 1 << 64)) + second[width:]
