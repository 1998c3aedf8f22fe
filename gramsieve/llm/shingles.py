"""Word shingles of whole texts as sets of 64-bit hashes, computed for a batch of texts at a time with NumPy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BACK = pow(_BASE, -1, 1 << 64)
_PAD = np.uint64(0xA0761D6478BD642F)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]).astype(np.uint64) for b in (_BASE, _BACK)]
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash a word of one text, A-Z lower-cased; words are runs of bytes that are no ASCII white space."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    power, back = _powers(len(b))
    solid = ~_SPACE[b]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _STEP)


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; with fewer words the whole sequence is one; without words none."""
    w = word_hashes(data)
    if not len(w):
        return w
    if len(w) < size:
        w = np.concatenate([w, np.full(size - len(w), _PAD)])
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = h * _STEP + w[i : i + len(h)]
    return np.unique(mixed(h))
