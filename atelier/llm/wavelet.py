"""A wavelet matrix: two-dimensional range reporting over points (position, value), for many rectangles at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Points at positions 0, 1, ... with a value each; values are below their number.

    Each level holds, for one bit of the values from the highest down, how many zeros stand before each
    place; the values are then parted by that bit, in their order. An interval of positions so becomes
    one interval for each prefix of bits, and a rectangle is reported in steps of one bit an answer.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            zero = (values >> b & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectangle and value of every point with a position in [lo, hi) and a value in [low, high); values are distinct."""
        rect = np.flatnonzero((lo < hi) & (low < high))
        lo, hi, prefix = lo[rect], hi[rect], np.zeros(len(rect), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            left, right = zeros[lo], zeros[hi]
            ones = zeros[-1]
            split = prefix + (1 << b)
            down = (left < right) & (low[rect] < split)
            up = (lo - left < hi - right) & (high[rect] > split)
            down &= high[rect] > prefix
            up &= low[rect] < split + (1 << b)
            rect, lo, hi, prefix = (
                np.concatenate([rect[down], rect[up]]),
                np.concatenate([left[down], (ones + lo - left)[up]]),
                np.concatenate([right[down], (ones + hi - right)[up]]),
                np.concatenate([prefix[down], split[up]]),
            )
        return rect, prefix
