"""SetSketch registers of shingle sets and the joint estimate of two of them.

Every element draws one ascending series of points, the j-th exponential truncated to the
j-th of ``m`` intervals, and deals them to the registers in an order of its own. A register
keeps the smallest point it gets, on a logarithmic scale: floor(1 - log_b(point)). Maxima of
registers merge sketches of unions; equal registers are as likely as the sets are alike.
"""

from __future__ import annotations

import numpy as np

from auditweave.llm.words import mix

REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, (1 << 16) - 2


class SetSketch:
    def __init__(self, m: int = REGISTERS, base: float = BASE, rate: float = RATE, top: int = TOP) -> None:
        self.m, self.base, self.rate, self.top = m, base, rate, top
        j = np.arange(m + 1, dtype=np.float64)
        with np.errstate(divide="ignore"):
            self.gamma = np.log1p(j / (m - j)) / rate  # where the j-th interval ends; the last is open
        self.share = -np.expm1(-rate * np.diff(self.gamma))
        self.share[-1] = 1.0

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers (uint16) of several sets of distinct 64-bit hashes, one row each."""
        with np.errstate(all="ignore"):
            return self._of(sets)

    def _of(self, sets: list[np.ndarray]) -> np.ndarray:
        m = self.m
        points = np.full(len(sets) * m, np.inf)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hashes = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        first = mix(hashes + np.uint64(0x632BE59BD9B4E019))
        stride = (mix(hashes ^ np.uint64(0x1F83D9ABFB41BD6B)) | np.uint64(1)).astype(np.int64)
        offset = (first >> np.uint64(40)).astype(np.int64)
        j = 0
        while j < m and len(hashes):
            drawn = mix(hashes + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
            uniform = (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53
            point = self.gamma[j] - np.log1p(-uniform * self.share[j]) / self.rate
            place = owner * m + ((offset + j * stride) & (m - 1))
            np.minimum.at(points, place, point)
            j += 1
            if j < m and (j < 16 or not j % 8):
                # a set whose registers all lie below the next interval is complete
                open_sets = points.reshape(-1, m).max(axis=1) > self.gamma[j]
                if not open_sets.all():
                    alive = open_sets[owner]
                    owner, hashes, stride, offset = owner[alive], hashes[alive], stride[alive], offset[alive]
        levels = np.floor(1.0 - np.log(points) / np.log(self.base))
        return np.clip(levels, 0, self.top + 1).astype(np.uint16).reshape(-1, m)

    def similarity(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Most likely Jaccard similarity of register rows, given the sizes of the sets.

        With u, v the shares of the two sets in their sum, a register of the first is larger
        with probability p_b(u - vJ), smaller with p_b(v - uJ), where
        p_b(x) = -log_b(1 - x (b - 1) / b). The likelihood is concave; its maximum is found
        by bisection on the derivative.
        """
        with np.errstate(all="ignore"):
            return self._similarity(a, b, n_a, n_b)

    def _similarity(self, a, b, n_a, n_b) -> np.ndarray:
        larger = (a > b).mean(axis=1)
        smaller = (a < b).mean(axis=1)
        equal = 1.0 - larger - smaller
        u = n_a / (n_a + n_b)
        v = 1.0 - u
        scale = (self.base - 1.0) / self.base
        log_b = np.log(self.base)

        def chance(x):
            return -np.log1p(-x * scale) / log_b

        def slope(x):
            return scale / (1.0 - x * scale) / log_b

        low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
        for _ in range(40):
            middle = (low + high) / 2
            x, y = u - v * middle, v - u * middle
            p, q = np.maximum(chance(x), 1e-12), np.maximum(chance(y), 1e-12)
            dp, dq = -v * slope(x), -u * slope(y)
            rise = larger * dp / p + smaller * dq / q - equal * (dp + dq) / np.maximum(1.0 - p - q, 1e-12)
            low, high = np.where(rise > 0, middle, low), np.where(rise > 0, high, middle)
        return (low + high) / 2
