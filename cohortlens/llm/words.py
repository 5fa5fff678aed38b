"""Word and shingle hashes of UTF-8 texts, for use inside tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` gives and the same as ``[^\\x20\\x09-\\x0D]+`` on the text.
"""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S31, _S29 = np.uint64(31), np.uint64(29)


class WordHashes(dict):
    """64-bit hash of each word, kept for repeated words; emptied when it has grown large."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S31)) * _MIX
    return (x ^ (x >> _S29)) * _ODD


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, in order; fewer words are one run as a whole; no words, none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h ^ word_hashes[j:n - k + 1 + j]) + _ODD
    return h
