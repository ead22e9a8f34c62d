"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .workers import cache, only

#: Word hashes that a Python worker keeps.
CACHE_WORDS = 400_000
_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)  # arrays wrap around silently, scalars warn


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = cache(WordHashes())


def keep_words() -> None:
    """For the start of a task: the worker drops what operators without word hashes have kept."""
    only(_known)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` word hashes, by doubling: O(log length) passes."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, covered = np.zeros(n, np.uint64), 0
    power, span, block = _ODD, 1, h
    bits = length
    while bits:
        if bits & 1:
            total = total * power + block[covered : covered + n]
            covered += span
        bits >>= 1
        if bits:
            m = len(block) - span
            block = block[:m] * power + block[span : span + m]
            power, span = power * power, span * 2
    return mix(total + np.uint64(length))
