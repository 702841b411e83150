"""Hashes of words and of runs of words, with numpy."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``size`` consecutive values: entry i stands for values i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, seed, dtype=np.uint64)
    for i in range(size):
        out = mix((out + hashes[i:i + n]) * PRIME)
    return out


def set_fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes, in any order."""
    parts = [np.sum(mix(hashes ^ np.uint64(c)), dtype=np.uint64) + np.uint64(len(hashes)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.array(parts, dtype="<u8").tobytes()
