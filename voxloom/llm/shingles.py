"""Word shingles and their MinHash values."""

from __future__ import annotations

import numpy as np

from .common import SPACES, mix, word_hashes

_RNG = np.random.default_rng(811)
_FACTORS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COLUMNS = 2048  # shingles that are permuted at a time


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    Words are what white space separates, in lower case. A text of fewer than ``width`` words has one shingle,
    all of it; one without words has none.
    """
    words, offsets = word_hashes([" ".join(t.lower().split()).encode("utf-8", "replace") for t in texts], SPACES)
    rows = max(len(words) - width + 1, 0)
    whole = np.zeros(rows, np.uint64)
    for k in range(width):
        whole += words[k : k + rows] * _FACTORS[k]
    whole = mix(whole)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _FACTORS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    """``size`` MinHash values of a set of 64-bit hashes, 32 bits each."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint32)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(hashes), _COLUMNS):
            x = self.a * low[at : at + _COLUMNS] + self.b
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            x ^= high[at : at + _COLUMNS]
            np.minimum(least, x.min(axis=1), out=least)
        return least


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each of ``bands`` equal bands of MinHash values; keys of different bands differ."""
    rows = values.reshape(bands, -1).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _FACTORS[-1]
    for k in range(rows.shape[1]):
        keys = mix(keys + rows[:, k] * _FACTORS[k])
    return keys
