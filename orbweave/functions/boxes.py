"""Boxes of one level as arrays of keys (numpy)."""

from __future__ import annotations

import numpy as np


def grid(keys: np.ndarray, level: int) -> np.ndarray:
    """Integer box coordinates (n, 3) at the keys' level."""
    bits = keys >> 15
    out = np.zeros((len(keys), 3), np.int64)
    for b in range(16):
        for axis in range(3):
            out[:, axis] |= (bits >> (3 * b + 2 - axis) & 1) << b
    return out >> (16 - level)


def key_of(cells: np.ndarray, level: int) -> np.ndarray:
    full = cells << (16 - level)
    bits = np.zeros(len(cells), np.int64)
    for b in range(16):
        for axis in range(3):
            bits |= (full[:, axis] >> b & 1) << (3 * b + 2 - axis)
    return bits << 15 | level
