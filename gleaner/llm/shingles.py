"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Odd multipliers of a run's words, by place.
_PLACES = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 3) & ((1 << 64) - 1) | 1) for k in range(64)]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, ASCII letters lowered (bytes.split separates at exactly the six ASCII white-space bytes)."""
    words = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; a shorter text is one shingle, one without words has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    each = min(words, len(h))
    out = np.full(len(h) - each + 1, each, np.uint64)
    for k in range(each):
        out += h[k : len(h) - each + 1 + k] * _PLACES[k]
    return np.unique(mix(out))
