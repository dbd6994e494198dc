"""Texts as arrays of code points, with hashes of all their windows, for work inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points that are looked at together; bounds a task's memory, whatever the texts' lengths.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of together at most limit characters (a longer text comes alone)."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text) + 1 if text else 1
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each followed by one 0; their starts and lengths. Null counts as empty."""
    joined = "\0".join(t or "" for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    return points, starts, lengths


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WindowHash:
    """Hashes of any windows of an array of code points: equal windows have equal hashes, wherever they stand."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        sums = mix(points.astype(np.uint64) + np.uint64(0x51ED270B))
        sums *= power[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(sums, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def windows(self, k: int) -> np.ndarray:
        """Of all windows of k characters, by their starts."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)
