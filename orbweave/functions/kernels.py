"""Green's functions as numpy matrices and as column expressions; coincident points contribute nothing.

A plan takes any ``Kernel``: a function of the points' difference that solves an elliptic equation away from 0. ``check`` holds a new one's
parts against each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FOUR_PI = 4 * np.pi
#: Entries of a full turn's table of cosines and sines, and a number that rounds what is added to it to whole numbers in its low bits.
TURN, ROUNDING = 4096, 1.5 * 2.0**52
_ANGLES = np.arange(TURN) * (2 * np.pi / TURN)
_COS, _SIN = np.cos(_ANGLES), np.sin(_ANGLES)


class Kernel(Protocol):
    """What a plan asks of a kernel."""

    #: Whether values are complex numbers.
    complex: bool
    #: d with K(a r) = a^d K(r) for all a > 0, so that one size's operators serve all; None if there is none.
    degree: int | None

    def matrix(self, targets: np.ndarray, sources: np.ndarray, gradient: bool = False) -> np.ndarray:
        """(targets, sources), or (4, targets, sources): the value and its derivatives by the target's coordinates."""

    def columns(self, dx: Column, dy: Column, dz: Column, q: Column, q_im: Column) -> dict[str, Column]:
        """Terms of the sums phi, gx, gy, gz (and ``_im`` of each, if complex) for the difference target - source."""

    # A kernel of the distance alone may have ``radial(r2, gradient)`` as well, and its sums are then several times as fast: of squared distances
    # above 0 (an array that it may overwrite), 4 pi times the value and, with gradient, 4 pi times the derivative by r over r; of a complex kernel
    # the real and the imaginary part of each.


@dataclass(frozen=True)
class Laplace:
    """1 / (4 pi r)."""

    degree = -1
    complex = False

    def matrix(self, targets: np.ndarray, sources: np.ndarray, gradient: bool = False) -> np.ndarray:
        """(targets, sources), or (4, targets, sources): the value and its derivatives by the target's coordinates."""
        d = targets[:, None, :] - sources[None, :, :]
        r2 = np.einsum("tsk,tsk->ts", d, d)
        with np.errstate(divide="ignore"):
            inv = np.where(r2 > 0, 1 / np.sqrt(r2), 0.0)
        value = inv / FOUR_PI
        if not gradient:
            return value
        slope = -value * inv * inv
        return np.concatenate([value[None], slope[None] * np.moveaxis(d, 2, 0)])

    def radial(self, r2: np.ndarray, gradient: bool = False) -> list[np.ndarray]:
        inv = np.divide(1.0, np.sqrt(r2, out=r2), out=r2)
        if not gradient:
            return [inv]
        slope = np.multiply(inv, inv)
        slope *= inv
        return [inv, np.negative(slope, out=slope)]

    def columns(self, dx: Column, dy: Column, dz: Column, q: Column, q_im: Column) -> dict[str, Column]:
        """Terms of the sums phi, gx, gy, gz for the difference target - source."""
        r2 = dx * dx + dy * dy + dz * dz
        value = F.when(r2 > 0, q / (F.lit(FOUR_PI) * F.sqrt(r2))).otherwise(F.lit(0.0))
        slope = F.when(r2 > 0, -value / r2).otherwise(F.lit(0.0))
        return {"phi": value, "gx": slope * dx, "gy": slope * dy, "gz": slope * dz}


@dataclass(frozen=True)
class Helmholtz:
    """exp(i k r) / (4 pi r)."""

    wavenumber: float
    degree = None
    complex = True

    def matrix(self, targets: np.ndarray, sources: np.ndarray, gradient: bool = False) -> np.ndarray:
        d = targets[:, None, :] - sources[None, :, :]
        r = np.sqrt(np.einsum("tsk,tsk->ts", d, d))
        with np.errstate(divide="ignore", invalid="ignore"):
            inv = np.where(r > 0, 1 / r, 0.0)
        value = np.exp(1j * self.wavenumber * r) * inv / FOUR_PI
        if not gradient:
            return value
        slope = value * (1j * self.wavenumber - inv) * inv
        return np.concatenate([value[None], slope[None] * np.moveaxis(d, 2, 0)])

    def radial(self, r2: np.ndarray, gradient: bool = False) -> list[np.ndarray]:
        k = float(self.wavenumber)
        r = np.sqrt(r2, out=r2)
        re, im = turned(r * k)
        inv = np.divide(1.0, r, out=r)
        re *= inv
        im *= inv
        if not gradient:
            return [re, im]
        # value * (i k - 1 / r) / r
        slope, slope_im = re * inv, im * inv
        slope += k * im
        slope_im -= k * re
        slope *= inv
        slope_im *= inv
        return [re, im, np.negative(slope, out=slope), np.negative(slope_im, out=slope_im)]

    def columns(self, dx: Column, dy: Column, dz: Column, q: Column, q_im: Column) -> dict[str, Column]:
        k = F.lit(float(self.wavenumber))
        r = F.sqrt(dx * dx + dy * dy + dz * dz)
        re, im = F.cos(k * r) / (F.lit(FOUR_PI) * r), F.sin(k * r) / (F.lit(FOUR_PI) * r)
        far = r > 0
        zero = F.lit(0.0)
        phi = F.when(far, re * q - im * q_im).otherwise(zero)
        phi_im = F.when(far, re * q_im + im * q).otherwise(zero)
        # d/dx = value * (i k - 1 / r) * d / r
        g = F.when(far, (-phi / r - k * phi_im) / r).otherwise(zero)
        g_im = F.when(far, (-phi_im / r + k * phi) / r).otherwise(zero)
        out = {"phi": phi, "phi_im": phi_im}
        for name, d in (("gx", dx), ("gy", dy), ("gz", dz)):
            out |= {name: g * d, f"{name}_im": g_im * d}
        return out


@dataclass(frozen=True)
class Yukawa:
    """exp(-r / screening) / (4 pi r): screened Laplace, real and without a degree."""

    screening: float
    degree = None
    complex = False

    def matrix(self, targets: np.ndarray, sources: np.ndarray, gradient: bool = False) -> np.ndarray:
        d = targets[:, None, :] - sources[None, :, :]
        r = np.sqrt(np.einsum("tsk,tsk->ts", d, d))
        with np.errstate(divide="ignore"):
            inv = np.where(r > 0, 1 / r, 0.0)
        value = np.exp(-r / self.screening) * inv / FOUR_PI
        if not gradient:
            return value
        slope = -value * (1 / self.screening + inv) * inv
        return np.concatenate([value[None], slope[None] * np.moveaxis(d, 2, 0)])

    def radial(self, r2: np.ndarray, gradient: bool = False) -> list[np.ndarray]:
        r = np.sqrt(r2, out=r2)
        value = r * (-1 / self.screening)
        np.exp(value, out=value)
        inv = np.divide(1.0, r, out=r)
        value *= inv
        if not gradient:
            return [value]
        slope = inv + 1 / self.screening
        slope *= inv
        slope *= value
        return [value, np.negative(slope, out=slope)]

    def columns(self, dx: Column, dy: Column, dz: Column, q: Column, q_im: Column) -> dict[str, Column]:
        r, length = F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(float(self.screening))
        value = F.when(r > 0, q * F.exp(-r / length) / (F.lit(FOUR_PI) * r)).otherwise(F.lit(0.0))
        slope = F.when(r > 0, -value * (1 / length + 1 / r) / r).otherwise(F.lit(0.0))
        return {"phi": value, "gx": slope * dx, "gy": slope * dy, "gz": slope * dz}


def turned(angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of angles (overwritten) from 0 to some 1e10, to 15 digits of 1: the table's entry of the nearest ``TURN``-th of a turn,
    turned by the rest, whose cosine and sine are short sums."""
    step = 2 * np.pi / TURN
    angle *= 1 / step
    near = angle + ROUNDING
    at = near.view(np.int64) & (TURN - 1)
    near -= ROUNDING
    angle -= near
    square = np.multiply(angle, angle, out=near)  # of at most 1/4, in steps
    c, s = np.take(_COS, at, mode="clip"), np.take(_SIN, at, mode="clip")
    turn = square * (-(step**3) / 6)
    turn += step
    turn *= angle  # the rest's sine
    # its cosine less 1: of -u/2 + u^2/24 for u = square * step^2 the line with the least error, 2e-15
    square *= step**2 * (step**2 / 96 - 0.5)
    square -= step**4 / 3072
    re, im = np.multiply(c, square, out=angle), np.multiply(s, square, out=square)
    re += c
    im += s
    c *= turn
    s *= turn
    re -= s
    im += c
    return re, im


def entries(kernel: Kernel, targets: np.ndarray, sources: np.ndarray) -> tuple:
    """Rows, columns and shape of a kernel's matrix, each evaluated when it is asked for."""
    return lambda i: kernel.matrix(targets[i : i + 1], sources)[0], lambda j: kernel.matrix(targets, sources[j : j + 1])[:, 0], (len(targets), len(sources))


def check(kernel: Kernel, spark=None, seed: int = 0) -> None:
    """Raises ValueError where a kernel contradicts itself: its degree, zeros at coincident points, derivatives against differences of
    values, dependence on differences alone, and, with a session, its columns against its matrix."""
    rng = np.random.default_rng(seed)
    t, s = rng.random((6, 3)), rng.random((5, 3)) + [1.5, 0, 0]
    whole, step = kernel.matrix(t, s, True), 1e-5
    value = kernel.matrix(t, s)

    def demand(sound: bool, what: str) -> None:
        if not sound:
            raise ValueError(f"{kernel!r}: {what}")

    demand(np.iscomplexobj(value) == kernel.complex, "values are complex numbers only where it says so")
    demand(whole.shape == (4, 6, 5) and np.allclose(whole[0], value), "the gradient's first part is the value")
    demand(not kernel.matrix(t, t).diagonal().any(), "coincident points contribute nothing")
    demand(np.allclose(kernel.matrix(t + 0.25, s + 0.25), value), "only differences count")
    for axis in range(3):
        h = np.eye(3)[axis] * step
        demand(np.allclose((kernel.matrix(t + h, s) - kernel.matrix(t - h, s)) / (2 * step), whole[1 + axis], rtol=1e-4, atol=1e-6), "derivatives are those of the value")
    if kernel.degree is not None:
        demand(np.allclose(kernel.matrix(2.0 * t, 2.0 * s), 2.0**kernel.degree * value), "it is homogeneous of its degree")
    both = np.concatenate([t, s])
    if by_distance(kernel):
        for gradient in (False, True):
            m = kernel.matrix(both, both, gradient)
            demand(np.allclose(evaluate(kernel, both, both, np.eye(11), gradient), m), "radial parts give the matrix")
    if spark is not None:
        q = rng.random(5) + (1j * rng.random(5) if kernel.complex else 0)
        rows = [(i, j, *map(float, t[i] - s[j]), float(q[j].real), float(q[j].imag)) for i in range(6) for j in range(5)]
        pairs = spark.createDataFrame(rows, "i int, j int, dx double, dy double, dz double, q double, q_im double")
        names = result_columns(kernel, True)
        terms = kernel.columns(*map(F.col, ("dx", "dy", "dz", "q", "q_im")))
        found = pairs.groupBy("i").agg(*[F.sum(terms[n]).alias(n) for n in names]).orderBy("i").toPandas()[names].to_numpy()
        sums = whole @ q
        expected = np.stack([x for part in sums for x in ((part.real, part.imag) if kernel.complex else (part,))], 1)
        demand(np.allclose(found, expected), "columns and matrix give the same sums")


def result_columns(kernel: Kernel, gradient: bool) -> list[str]:
    names = ["phi", *(["gx", "gy", "gz"] if gradient else [])]
    return [n for name in names for n in ([name, f"{name}_im"] if kernel.complex else [name])]


#: Edge of a tile of pairs, whose arrays stay in a core's cache, and sources that go by one centre.
TILE, RUN = 192, 1 << 15
#: Squared distances up to this share of those to a tile's centre come from differences of coordinates: from products they have too few digits.
CLOSE = 1 / 128


def evaluate(kernel: Kernel, targets: np.ndarray, sources: np.ndarray, q: np.ndarray, gradient: bool = False, block: int = 1 << 21) -> np.ndarray:
    """Sums over all sources: (targets, vecs), or (4, targets, vecs), in blocks of bounded size."""
    sound = lambda x: len(x) and np.abs(x).max() < 1e100
    if by_distance(kernel) and sound(targets) and sound(sources):
        out = _tiles(kernel, targets, sources, q, gradient)
        return out if gradient else out[0]
    width = 4 if gradient else 1
    out = np.zeros((width, len(targets), q.shape[1]), np.result_type(q, complex if kernel.complex else float))
    step = max(1, block // max(1, len(sources)) // width)
    for lo in range(0, len(targets), step):
        m = kernel.matrix(targets[lo : lo + step], sources, gradient)
        out[:, lo : lo + step] = (m if gradient else m[None]) @ q
    return out if gradient else out[0]


def by_distance(kernel: Kernel) -> bool:
    """Whether a kernel has radial parts, and not only inherits them beside a matrix of its own."""
    own = next((vars(c) for c in type(kernel).__mro__ if "matrix" in vars(c) or "radial" in vars(c)), {})
    return "radial" in own


def _by_place(x: np.ndarray) -> np.ndarray:
    """An order of points in which neighbours are close together."""
    if len(x) <= 4 * TILE:
        return np.arange(len(x))
    low, edge = x.min(0), max(float(np.ptp(x, axis=0).max()), 1e-300)
    cells, code = np.minimum((x - low) / edge * 128, 127).astype(np.int64), np.zeros(len(x), np.int64)
    for b in range(7):
        for axis in range(3):
            code |= (cells[:, axis] >> b & 1) << (3 * b + axis)
    return np.argsort(code, kind="stable")


def _tiles(kernel: Kernel, targets: np.ndarray, sources: np.ndarray, q: np.ndarray, gradient: bool) -> np.ndarray:
    """(width, targets, vecs) of a kernel of the distance alone, tile by tile of pairs of neighbouring points.

    With coordinates from the middle of a tile's targets, squared distances are one product, |t|^2 + |s|^2 - 2 t.s, and derivatives t (slope @ q) -
    slope @ (q s). Pairs too close for that are taken by their differences, one by one, or as a matrix where they are many.
    """
    n_vecs, width = q.shape[1], 4 if gradient else 1
    parts = 2 if kernel.complex else 1
    loads = np.concatenate([q.real, q.imag], 1) if np.iscomplexobj(q) and q.imag.any() else np.ascontiguousarray(q.real)
    n_loads = loads.shape[1]
    t_order, s_order = _by_place(targets), _by_place(sources)
    targets, sources, q, loads = targets[t_order], sources[s_order], q[s_order], loads[s_order] / FOUR_PI
    sums = np.zeros((parts, width, len(targets), n_loads))
    whole = np.zeros((width, len(targets), n_vecs), np.result_type(q, complex if kernel.complex else float))
    for first in range(0, len(sources), RUN):
        theirs, theirs_q = sources[first : first + RUN], loads[first : first + RUN]
        for lo in range(0, len(targets), TILE):
            hi = min(lo + TILE, len(targets))
            middle = (targets[lo:hi].min(0) + targets[lo:hi].max(0)) / 2
            t, s = targets[lo:hi] - middle, theirs - middle
            tt, ss = (t * t).sum(1), (s * s).sum(1)
            left, right = np.column_stack([t, tt, np.ones(len(t))]), np.concatenate([-2 * s.T, np.ones((1, len(s))), ss[None]])
            moments = np.concatenate([theirs_q, *[theirs_q * s[:, i : i + 1] for i in range(3)]], 1) if gradient else theirs_q
            step = max(TILE, TILE * TILE // len(t))
            close = CLOSE * (tt.max() + np.maximum.reduceat(ss, np.arange(0, len(s), step)))
            found = np.zeros((parts, len(t), n_loads))
            slopes = np.zeros((parts, len(t), moments.shape[1])) if gradient else None
            for i, limit in enumerate(close.tolist()):
                a, b = i * step, min((i + 1) * step, len(s))
                r2, near = left @ right[:, a:b], None
                if r2.min() <= limit:
                    near = np.flatnonzero(r2 <= limit)
                    if 8 * len(near) > r2.size:
                        m = kernel.matrix(targets[lo:hi], theirs[a:b], gradient)
                        whole[:, lo:hi] += (m if gradient else m[None]) @ q[first + a : first + b]
                        continue
                    r2.reshape(-1)[near] = limit
                made = kernel.radial(r2, gradient)
                for k, m in enumerate(made):
                    if near is not None:
                        m.reshape(-1)[near] = 0
                    if k < parts:
                        found[k] += m @ theirs_q[a:b]
                    else:
                        slopes[k - parts] += m @ moments[a:b]
                if near is not None:
                    _near_pairs(kernel, targets[lo:hi], theirs[a:b], theirs_q[a:b], *np.divmod(near, b - a), sums[:, :, lo:hi], gradient)
            sums[:, 0, lo:hi] += found
            if gradient:
                for axis in range(3):
                    sums[:, 1 + axis, lo:hi] += t[:, axis : axis + 1] * slopes[:, :, :n_loads] - slopes[:, :, (1 + axis) * n_loads : (2 + axis) * n_loads]
    if kernel.complex:
        mine = sums[0] + 1j * sums[1]  # of the loads' real parts, and of their imaginary parts
        whole += mine[:, :, :n_vecs] + (1j * mine[:, :, n_vecs:] if n_loads > n_vecs else 0)
    elif n_loads > n_vecs:
        whole += sums[0][:, :, :n_vecs] + 1j * sums[0][:, :, n_vecs:]
    else:
        whole += sums[0]
    out = np.empty_like(whole)
    out[:, t_order] = whole
    return out


def _near_pairs(kernel: Kernel, targets, sources, loads, i: np.ndarray, j: np.ndarray, sums: np.ndarray, gradient: bool) -> None:
    """Adds the terms of single pairs (i, j) to sums (parts, width, targets, loads); those of coincident points are nothing."""
    d = targets[i] - sources[j]
    r2 = (d * d).sum(1)
    apart = r2 > 0
    made = kernel.radial(np.where(apart, r2, 1.0), gradient)
    for k, m in enumerate(made):
        m[~apart] = 0
        terms = m[:, None] * loads[j]
        part, slope = k % len(sums), k >= len(sums)
        for v in range(loads.shape[1]):
            if not slope:
                sums[part, 0, :, v] += np.bincount(i, terms[:, v], len(targets))
            else:
                for axis in range(3):
                    sums[part, 1 + axis, :, v] += np.bincount(i, terms[:, v] * d[:, axis], len(targets))
