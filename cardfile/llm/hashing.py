"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; n takes part in it."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, n, np.uint64)
    for i in range(n if count else 0):
        out = (out ^ hashes[i : count + i]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out
