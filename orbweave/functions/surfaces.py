"""Surface and convolution grids of boxes, and the FFT embedding (numpy; static for an expansion order)."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np

#: Scales of the inner (equivalent upward, check downward) and outer surfaces.
INNER, OUTER = 1.05, 2.95


def n_coeffs(p: int) -> int:
    """Points on the surface of a p x p x p grid."""
    if p < 2:
        raise ValueError("an expansion order is 2 or more")
    return 6 * (p - 1) ** 2 + 2


@lru_cache(maxsize=64)
def surface_indices(p: int) -> np.ndarray:
    """Integer (i, j, k) of the shell, k outermost."""
    n_coeffs(p)
    return np.array([(i, j, k) for k, j, i in product(range(p), repeat=3) if 0 in (i, j, k) or p - 1 in (i, j, k)])


def surface_grid(p: int) -> np.ndarray:
    """The shell in [-1, 1]^3."""
    return surface_indices(p) * (2.0 / (p - 1)) - 1


def scaled_surface(p: int, centre: np.ndarray, diameter: float, alpha: float) -> np.ndarray:
    return surface_grid(p) * (diameter * alpha / 2) + np.asarray(centre)


def convolution_grid(p: int, centre: np.ndarray, diameter: float, alpha: float) -> np.ndarray:
    """(2p - 1)^3 points at the surface's spacing, x fastest, whose largest corner is the source surface's largest corner."""
    step = diameter * alpha / (p - 1)
    top = np.asarray(centre) + diameter * alpha / 2
    at = np.arange(2 * p - 1) - (2 * p - 2)
    k, j, i = np.meshgrid(at, at, at, indexing="ij")
    return top + step * np.stack([i, j, k], -1).reshape(-1, 3)


def charges_on_grid(p: int, charges: np.ndarray) -> np.ndarray:
    """(..., n_coeffs) surface values on the octant p..2p-1 of a (2p)^3 grid indexed [k, j, i]."""
    out = np.zeros((*charges.shape[:-1], 2 * p, 2 * p, 2 * p), charges.dtype)
    i, j, k = (surface_indices(p) + p).T
    out[..., k, j, i] = charges
    return out


def checks_from_grid(p: int, grid: np.ndarray) -> np.ndarray:
    """The shell of the octant 0..p-1."""
    i, j, k = surface_indices(p).T
    return grid[..., k, j, i]
