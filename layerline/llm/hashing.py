"""Vectorised hashes of byte and word windows.

A window's hash is polynomial over 64-bit symbol values, so one running sum gives the hash of any window of any length.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTE_VALUES = np.random.RandomState(20).randint(1, 1 << 62, (2, 256), dtype=np.int64).astype(np.uint64)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of each base that a process keeps, at most this many.
KEPT = 1 << 21
POWERS: dict[int, np.ndarray] = {}


def powers_of(base: int, n: int) -> np.ndarray:
    """The powers 0 to ``n`` of a base, modulo 2^64."""
    known = POWERS.get(base)
    if known is not None and len(known) > n:
        return known[: n + 1]
    powers = np.full(max(n, min(2 * n, KEPT)) + 1, base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    if n <= KEPT:
        POWERS[base] = powers
    return powers[: n + 1]


class Windows:
    """Hashes of windows over one array of symbol values."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        powers = powers_of(base, n)
        self.inverse = powers_of(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes of several texts, and the number of words before each text and in all."""
    letter = np.zeros(len(data) + 1, bool)
    letter[:-1] = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, letter[:-1]]
    starts = np.flatnonzero(letter & (~before | edge))
    ends = np.flatnonzero(before & (~letter | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    windows = Windows(BYTE_VALUES[which][data], BASES[which])
    return windows(starts, ends - starts) + (ends - starts).astype(np.uint64)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each window of that many keys."""
    least, span = keys, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
