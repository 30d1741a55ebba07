"""Anchored windows: content-chosen suffixes that stand for all fixed-length windows of a byte string.

Every window of `length` bytes has an anchor, the leftmost of its `gram`-byte strings with the least hash. Equal windows
have the same anchor at the same place, so equal windows are found by comparing only anchored suffixes.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all runs of `gram` (a power of two) bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    size, base = 1, _BASE
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        h ^= h >> np.uint64(29)
        base = (base * base + 2 * size) & _MASK | 1
        size *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the leftmost least one."""
    n = len(h)
    low = np.uint64((1 << 21) - 1)
    keyed = (h & ~low) | np.arange(n, dtype=np.uint64)  # ties of the upper bits go to the left
    span = 1
    while span * 2 <= width:
        keyed = np.minimum(keyed[:-span], keyed[span:])
        span *= 2
    rest = width - span
    if rest:
        keyed = np.minimum(keyed[:-rest], keyed[rest:])
    return (keyed & low).astype(np.int64)


def runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside the segments that begin at starts: (anchor, first window, last window, gram hash).

    A run of neighbouring windows with one anchor is one row. data must be shorter than 2**21 bytes."""
    width = length - gram + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data, gram)
    at = leftmost_least(h, width)
    bounds = np.append(starts, len(data))
    segment = np.repeat(np.arange(len(starts)), np.diff(bounds))
    windows = np.arange(len(at))
    inside = segment[windows] == segment[windows + length - 1]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(change & inside)
    ends = np.ones(len(at), bool)
    ends[:-1] = change[1:] | ~inside[1:]
    end = np.flatnonzero(ends & inside)
    return at[begin], begin, end, h[at[begin]]
