"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import LOWER_BYTES

#: Words in a shingle.
SHINGLE = 5
#: Shingles of a text that are hashed at a time.
STRETCH = 200_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        n = max(n + 1, 2 * len(_powers))
        factors = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        for f in factors:
            f[0] = 1
        _powers, _inverses = (np.multiply.accumulate(f) for f in factors)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(LOWER_BYTES).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    width = min(size, len(words))
    parts = []
    for begin in range(0, len(words) - width + 1, STRETCH):
        part = words[begin : begin + STRETCH + width - 1]
        line = np.frombuffer(b" ".join(part), np.uint8)
        _grow(len(line))
        # polynomial prefix sums; a shingle is a difference, shifted to the same power
        sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(_BYTES[line] * _powers[: len(line)], out=sums[1:])
        gaps = np.flatnonzero(line == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))
        first, last = starts[: len(part) - width + 1], ends[width - 1 :]
        parts.append(mixed((sums[last] - sums[first]) * _inverses[first] + (last - first).astype(np.uint64)))
    out = np.sort(np.concatenate(parts))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def identity(found: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    return int(mixed(np.array([mixed(found + _U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + _U(len(found))], np.uint64)).view(np.int64)[0])
