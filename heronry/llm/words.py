"""Words and word shingles as 64-bit hashes, over UTF-8 bytes.

A word is a run without space or tab, line feed, vertical tab, form feed, carriage return:
exactly what ``bytes.split()`` gives.  ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
MIX1, MIX2, STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """word bytes -> xxh64; forgets everything once ``most`` words are held, so memory stays bounded."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; of the whole sequence if it is shorter; empty without words."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = mixed(hashes[: len(hashes) - n + 1] + STEP)
    for i in range(1, n):
        out = mixed(out * STEP + hashes[i : len(hashes) - n + 1 + i])
    return out
