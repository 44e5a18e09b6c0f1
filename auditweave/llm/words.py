"""Words and shingles of one text as numpy arrays of 64-bit hashes; runs inside tasks.

A word is a run of bytes other than space and 0x09-0x0D in the UTF-8 text. Hashes are
sums of a random value per byte times a power of an odd base, so the hash of any stretch
is a difference of two running sums; a mixer then spreads the bits.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each value (a bijection on 64 bits)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    if lower:
        values[65:91] = values[97:123]
    return values


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def ready(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            steps = np.full(size, _BASE, dtype=np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = _INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)


class Reader:
    """Splits texts into hashed words; ``lower`` folds A-Z only."""

    def __init__(self, lower: bool = True) -> None:
        self.values = byte_values(lower)
        self.powers = Powers()
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def bounds(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where words start and end."""
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~self.blank[np.frombuffer(data, dtype=np.uint8)]
        turns = np.flatnonzero(np.diff(inside))
        return turns[::2], turns[1::2]

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words."""
        starts, ends = self.bounds(data)
        if not len(starts):
            return starts, ends, np.zeros(0, dtype=np.uint64)
        self.powers.ready(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        raw = np.frombuffer(data, dtype=np.uint8)
        np.cumsum(self.values[raw] * self.powers.up[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.powers.down[starts]
        return starts, ends, mix(hashes + (ends - starts).astype(np.uint64))

    def stretches(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of every k consecutive words; fewer than k words give none."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        self.powers.ready(len(hashes))
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.powers.up[: len(hashes)], out=sums[1:])
        return mix((sums[k:] - sums[:n]) * self.powers.down[:n])

    def shingles(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k-word shingles; a shorter text is one shingle, no words give none."""
        if len(hashes) < k:
            k = max(len(hashes), 1)
        return self.stretches(hashes, k)

    def shingle_set(self, text: str | None, k: int) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        return np.unique(self.shingles(self.words(data)[2], k))
