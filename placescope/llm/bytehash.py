"""Vectorised 64-bit digests of substrings of a byte buffer.

A byte b at place i adds ``TABLE[b] * BASE**i`` (mod 2**64) to a running sum; the digest of [s, e) is
the difference of two sums divided by ``BASE**s``, so it depends on the bytes alone.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2**64
_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a buffer, one more than its bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    if len(data):
        terms = TABLE[data]
        terms *= _power_table(BASE, len(data))
        np.cumsum(terms, out=out[1:])
    return out


def digests(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of the substrings [start, end) of the buffer that ``running`` belongs to."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix((running[end] - running[start]) * _power_table(_INVERSE, len(running))[start])
