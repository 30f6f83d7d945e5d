"""Hashes of words and of runs of words, vectorised."""

from __future__ import annotations

import numpy as np
import xxhash

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text; bytes.split() parts at x20 and x09 to x0D, as the word pattern does."""
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= FACTOR
        out ^= out >> np.uint64(32)
        out += words[i : i + n]
    return mixed(out)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones."""
    span, out = 1, h
    while 2 * span <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    n = len(h) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])
