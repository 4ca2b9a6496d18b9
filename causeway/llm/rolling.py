"""Hashes of all k-character windows of texts, computed without a loop over characters."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so every power is invertible mod 2^64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(points: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size k the hashes of points[i:i+k] for all i; empty where points are fewer than k.

    Windows of length 2m come from two of length m, so all sizes together take
    about 2 log2(k) passes.
    """
    n = len(points)
    # characters are mixed first, so that texts over few characters do not share hashes by arithmetic
    level, levels = mix(points.astype(np.uint64) + np.uint64(1)), {}
    m, top = 1, max(sizes)
    while True:
        levels[m] = level
        if m * 2 > top or len(level) <= m:
            break
        level = level[: len(level) - m] * np.uint64(pow(_BASE, m, 1 << 64)) + level[m:]
        m *= 2
    out = []
    for k in sizes:
        if n < k:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        total, at, length = np.zeros(n - k + 1, dtype=np.uint64), 0, n - k + 1
        for m in sorted(levels, reverse=True):
            if k & m:
                total = total * np.uint64(pow(_BASE, m, 1 << 64)) + levels[m][at : at + length]
                at += m
        out.append(mix(total))
    return out
