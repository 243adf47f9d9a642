"""Hashed character n-grams of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from folioforge.llm.columns import code_points

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint32)


@lru_cache(maxsize=2)
def _kind(digits: bool) -> np.ndarray:
    """For each code point whether it is kept: letters, and digits too if asked for."""
    test = str.isalnum if digits else str.isalpha
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


def normal_points(texts: list[str], digits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case with a space for whatever is left out, offsets, letters per text)."""
    points, offsets = code_points([t.lower() for t in texts])
    kept = _kind(digits)[points]
    letters = np.add.reduceat(kept, offsets[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return np.where(kept, points, np.uint32(32)), offsets, letters


def gram_buckets(points: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each point; 2**bits where it would leave its text."""
    size = len(points)
    if size < n:
        return np.full(size, 1 << bits, np.uint32)
    h = np.zeros(size, np.uint32)
    base = points * np.uint32(0x9E3779B1)
    base ^= base >> np.uint32(15)
    for j in range(n):
        h[: size - j] += (base[j:] + np.uint32(j)) * _MIX[j]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D + 2 * n)
    h >>= np.uint32(32 - bits)
    for j in range(1, n):
        cut = offsets[1:] - j
        h[cut[cut >= offsets[:-1]]] = 1 << bits
    return h
