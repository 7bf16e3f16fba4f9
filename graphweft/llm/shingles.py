"""64-bit hashes of words and word shingles, a batch of texts at a time.

A word's hash is a polynomial over random byte values modulo 2^64, mixed; all words of a batch come
from one prefix sum. Different shingles share a hash with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^ \\t-\\r]+` after lower-casing A-Z, and where each text's begin (one more for the end)."""
    folded = [(t or b"").translate(_LOWER) for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in folded)])
    raw = np.frombuffer(b" ".join((*folded, b"")), np.uint8)
    gap = _SPACE[raw]
    before = np.concatenate(([True], gap[:-1]))
    first, end = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)))
    hashes = mix((sums[end] - sums[first]) * _powers(_BASE_INVERSE, len(raw))[first])
    return hashes, np.searchsorted(first, starts)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, rising; a text of fewer words, but not none, is one shingle."""
    hashes, bounds = word_hashes(texts)
    factors = [mix(np.array([2 * i + 1], np.uint64)) | np.uint64(1) for i in range(words)]
    lengths = mix(np.arange(words, dtype=np.uint64) + np.uint64(1 << 32))
    n = len(hashes) - words + 1
    rolling = np.zeros(max(0, n), np.uint64)
    for i, f in enumerate(factors):
        rolling += hashes[i : i + len(rolling)] * f
    rolling = mix(rolling)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolling[a : b - words + 1]))
        elif b > a:
            own = hashes[a:b] * np.concatenate(factors[: b - a])
            out.append(mix(np.add.reduce(own, keepdims=True) + lengths[b - a : b - a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
