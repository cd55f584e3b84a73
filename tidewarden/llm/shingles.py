"""Distinct word shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, in order: words are runs of other than blanks, A-Z in lower case."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    solid = ~_BLANK[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    power = np.cumprod(np.full(int(length.max()), _BASE))
    letters = raw[solid].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(length) - length
    at = np.arange(len(letters)) - np.repeat(first, length)
    return mix(np.add.reduceat(letters * power[at], first) + length.astype(np.uint64))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles; of fewer words the whole sequence is one; of none there is none."""
    hashes = word_hashes(text)
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, words)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k:n - width + 1 + k]
    return np.unique(mix(out))
