"""Hashes of words and of runs of words, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbouring words, mixed so that any of its bits may be used alone."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * np.uint64(pow(_BASE, k, 1 << 64))
    return mix(out)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = h ^ np.uint64(seed * _BASE & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
