"""Translation operators of a kernel-independent expansion, built once for a plan (numpy).

Equivalent surfaces hold charges, check surfaces hold potentials. For a homogeneous kernel every operator is assembled for
boxes of edge 1 (children 1/2) and serves all levels; other kernels have operators for each level. The far-field
operator has five forms: dense, SVD of the stacked matrices (``SaRcmp``), SVD of each (``Ia``), cross approximation
(``Aca``) and Fourier transforms (``Fft``).
"""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import product

import numpy as np

from orbweave.functions import kernels, linalg, surfaces
from orbweave.functions.boxes import grid, key_of
from orbweave.functions.surfaces import INNER, OUTER

#: Offsets source - target of far-field pairs: up to 3 boxes on an axis, 2 or 3 on one at least.
OFFSETS = [d for d in product(range(-3, 4), repeat=3) if max(map(abs, d)) >= 2]
DIRECTIONS = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
CHILDREN = np.array([(i >> 2 & 1, i >> 1 & 1, i & 1) for i in range(8)])


@dataclass(frozen=True)
class Dense:
    """Uncompressed far-field matrices."""

    surface_diff: int = 0
    many_vectors = True


@dataclass(frozen=True)
class RandomSvd:
    """Settings of the randomised SVD: of fixed rank, or with ``tolerance`` of as many vectors as leave no larger error."""

    n_components: int | None = None
    tolerance: float | None = None
    n_oversamples: int = 10
    n_iterations: int = 1
    seed: int = 0


@dataclass(frozen=True)
class SaRcmp:
    """One basis for all transfer vectors from the SVDs of the stacked matrices, then small cores."""

    threshold: float | None = None
    surface_diff: int = 0
    svd: RandomSvd | None = None
    many_vectors = True


@dataclass(frozen=True)
class Ia:
    """A low-rank pair for each transfer vector (and level) by SVD; not for homogeneous kernels."""

    threshold: float | None = None
    surface_diff: int = 0
    svd: RandomSvd | None = None
    many_vectors = True


@dataclass(frozen=True)
class Aca:
    """A low-rank pair for each transfer vector by cross approximation."""

    eps: float = 1e-9
    surface_diff: int = 0
    seed: int = 0
    many_vectors = True


@dataclass(frozen=True)
class Fft:
    """Diagonal in frequency space; one right-hand side."""

    block_size: int = 128
    surface_diff = 0
    many_vectors = False


@dataclass(frozen=True)
class Pinv:
    """Pseudo-inverse by SVD, or by cross approximation first."""

    aca: bool = False
    atol: float = 0.0
    rtol: float | None = None

    def __call__(self, kernel, check: np.ndarray, equivalent: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        rtol = max(len(check), len(equivalent)) * float(np.finfo(np.float32).eps) if single and self.rtol is None else self.rtol
        if self.aca:
            return linalg.pinv_aca(kernels.entries(kernel, check, equivalent), rtol=rtol)
        return linalg.pinv(kernel.matrix(check, equivalent), self.atol, rtol)


@dataclass
class Operators:
    """All operators of a plan; those of each level are made when asked for and kept."""

    kernel: object
    side: float
    depth: int
    orders: list[int]
    m2l: object = field(default_factory=Fft)
    pinv: Pinv = field(default_factory=Pinv)
    #: Whether expansions and operators are held in 32 bits (operators are made in 64 all the same).
    single: bool = False
    _made: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if len(self.orders) not in (1, self.depth + 1):
            raise ValueError("orders: one, or one for each level")
        if min(self.orders) < 2:
            raise ValueError("an expansion order is 2 or more")
        if isinstance(self.m2l, Ia) and self.kernel.degree is not None:
            raise ValueError("individual compression is for kernels that are not homogeneous")

    @property
    def dtype(self):
        """Of expansions."""
        return self.held(np.zeros(0, self.result_dtype)).dtype

    @property
    def result_dtype(self):
        """Of sums at points: 64 bits always."""
        return np.complex128 if self.kernel.complex else np.float64

    def held(self, a: np.ndarray) -> np.ndarray:
        """An array as the plan holds it."""
        return a.astype(np.complex64 if np.iscomplexobj(a) else np.float32) if self.single else a

    def order(self, level: int) -> int:
        return self.orders[level if len(self.orders) > 1 else 0]

    def check_order(self, level: int) -> int:
        return self.order(level) + self.m2l.surface_diff

    def n_coeffs(self, level: int) -> int:
        return surfaces.n_coeffs(self.order(level))

    def size(self, level: int) -> float:
        """Edge of the boxes an operator of this level is assembled for."""
        return 1.0 if self.kernel.degree is not None else self.side / 2**level

    def scale(self, level: int) -> float:
        """Factor of potentials-to-charges at a level whose operator was assembled for another size."""
        return (self.side / 2**level) ** -self.kernel.degree if self.kernel.degree is not None else 1.0

    def _kept(self, key, make):
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def part(self, *kinds: str, far: int | None = None) -> Operators:
        """A copy with the operators of some kinds only (and one level's far field): what a task is sent."""
        wanted = lambda k: k[0] in kinds or (far is not None and k == ("far", self._key(far)))
        made = {k: v for k, v in self._made.items() if wanted(k)}
        for k, v in made.items():
            if k[0] == "far":  # it holds its operators: only what it needs itself
                made[k] = copy(v)
                made[k].ops = replace(self, _made={})
        return replace(self, _made=made)

    def _key(self, *levels: int):
        return tuple((self.order(x), self.check_order(x), None if self.kernel.degree is not None else x) for x in levels)

    def _surface(self, order: int, centre, size: float, alpha: float) -> np.ndarray:
        return surfaces.scaled_surface(order, centre, size, alpha)

    def inverse(self, level: int, up: bool) -> tuple[np.ndarray, np.ndarray]:
        """Factors of check potentials to equivalent charges."""
        return self._kept(("inverse", up, self._key(level)), lambda: tuple(map(self.held, self._inverse(level, up))))

    def _inverse(self, level: int, up: bool, size: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        size = self.size(level) if size is None else size
        check, equivalent = (OUTER, INNER) if up else (INNER, OUTER)

        def make():
            zero = np.zeros(3)
            return self.pinv(self.kernel, self._surface(self.check_order(level), zero, size, check), self._surface(self.order(level), zero, size, equivalent), self.single)

        return self._kept(("inverse64", up, size, self._key(level)), make)

    def m2m(self, level: int) -> np.ndarray:
        """(8, parent coefficients, child coefficients) from children of ``level`` to their parents."""

        def make():
            size = self.size(level - 1)
            check = self._surface(self.check_order(level - 1), np.zeros(3), size, OUTER)
            left, right = self._inverse(level - 1, True)
            return self.held(np.stack([left @ (right @ self.kernel.matrix(check, self._surface(self.order(level), (c - 0.5) * size / 2, size / 2, INNER))) for c in CHILDREN]))

        return self._kept(("m2m", self._key(level - 1, level)), make)

    def l2l(self, level: int) -> np.ndarray:
        """(8, child coefficients, parent coefficients) from parents to children of ``level``."""

        def make():
            size = self.size(level - 1)
            equivalent = self._surface(self.order(level - 1), np.zeros(3), size, OUTER)
            left, right = self._inverse(level, False, size / 2)
            return self.held(np.stack([left @ (right @ self.kernel.matrix(self._surface(self.check_order(level), (c - 0.5) * size / 2, size / 2, INNER), equivalent)) for c in CHILDREN]))

        return self._kept(("l2l", self._key(level - 1, level)), make)

    def far_surfaces(self, level: int, offset) -> tuple[np.ndarray, np.ndarray]:
        """Check points of a box and equivalent points of the box an offset away."""
        size = self.size(level)
        return self._surface(self.check_order(level), np.zeros(3), size, INNER), self._surface(self.order(level), np.array(offset) * size, size, INNER)

    def far_matrix(self, level: int, offset) -> np.ndarray:
        return self.kernel.matrix(*self.far_surfaces(level, offset))

    @property
    def far_kind(self) -> type[FarField]:
        return {Dense: DenseField, SaRcmp: StackedField, Ia: PairField, Aca: PairField, Fft: FourierField}[type(self.m2l)]

    def far(self, level: int, pieces: dict | None = None) -> FarField:
        """The far-field operator of a level, in the plan's form; from its pieces if they have been made already."""
        return self._kept(("far", self._key(level)), lambda: self.far_kind(self, level, pieces))

    def far_levels(self) -> list[int]:
        """A level for each far-field operator that differs."""
        return sorted({self._key(level): level for level in range(self.depth, 1, -1)}.values())

    # -- what expansions go through -----------------------------------------------------------------------------------

    def p2m(self, points: np.ndarray, q: np.ndarray, centres: np.ndarray, sizes: np.ndarray, level: int) -> np.ndarray:
        """(leaves, vecs, coefficients) of leaves of a level, whose ``sizes`` points stand one after another: check potentials around each
        leaf's centre, summed by leaf, then one product for all leaves."""
        left, right = self.inverse(level, True)
        return self._checks(points, q, centres, sizes, level, OUTER) @ right.T @ left.T * self.scale(level)

    def p2l(self, points: np.ndarray, q: np.ndarray, centres: np.ndarray, sizes: np.ndarray, level: int) -> np.ndarray:
        """(boxes, vecs, check points): potentials of points outside on the inner check surfaces of boxes of a level, scaled as the far field's."""
        return self._checks(points, q, centres, sizes, level, INNER) * self.scale(level)

    def _checks(self, points, q, centres, sizes, level, alpha) -> np.ndarray:
        surface = surfaces.scaled_surface(self.check_order(level), np.zeros(3), self.side / 2**level, alpha)
        out = np.zeros((len(sizes), q.shape[1], len(surface)), self.dtype)
        box = np.repeat(np.arange(len(sizes)), sizes)
        step = max(1, (1 << 21) // len(surface))
        for lo in range(0, len(points), step):
            mine = box[lo : lo + step]
            k = self.kernel.matrix(surface, points[lo : lo + step] - centres[mine])
            begins = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            for v in range(q.shape[1]):
                out[mine[begins], v] += np.add.reduceat(k * q[lo : lo + step, v], begins, axis=1).T
        return out

    def l2p(self, points: np.ndarray, local: np.ndarray, centre: np.ndarray, level: int, gradient: bool) -> np.ndarray:
        """(width, points, vecs) at the points of a leaf."""
        equivalent = surfaces.scaled_surface(self.order(level), centre, self.side / 2**level, OUTER)
        sums = kernels.evaluate(self.kernel, points, equivalent, local, gradient)
        return sums if gradient else sums[None]

    def m2p(self, points: np.ndarray, multipoles: np.ndarray, centres: np.ndarray, level: int, gradient: bool) -> np.ndarray:
        """(width, points, vecs) of boxes' multipoles (boxes, vecs, coefficients) of a level, at points outside their check surfaces."""
        surface = surfaces.scaled_surface(self.order(level), np.zeros(3), self.side / 2**level, INNER)
        sources = (surface[None] + centres[:, None]).reshape(-1, 3)
        sums = kernels.evaluate(self.kernel, points, sources, multipoles.transpose(0, 2, 1).reshape(len(sources), -1), gradient)
        return sums if gradient else sums[None]

    def check_to_local(self, level: int, check: np.ndarray) -> np.ndarray:
        """(n, vecs, coefficients) from far-field check potentials; the scale cancels with the sources'."""
        left, right = self.inverse(level, False)
        return check @ right.T @ left.T


class FarField:
    """apply: multipoles (n_sources, vecs, coefficients) to check potentials (n_targets, vecs, check points).

    What is made for each offset can be made elsewhere, by ``piece``, and given as ``pieces``.
    """

    def __init__(self, ops: Operators, level: int, pieces: dict | None = None):
        self.ops, self.level = ops, level
        self.n_check = surfaces.n_coeffs(ops.check_order(level))
        self.pieces = pieces or {o: self.piece(ops, level, o) for o in OFFSETS}

    @staticmethod
    def piece(ops: Operators, level: int, offset: tuple):
        """The matrix of an offset."""
        return ops.far_matrix(level, offset)

    def apply(self, multipoles: np.ndarray, sources: np.ndarray, targets: np.ndarray, level: int) -> np.ndarray:
        """Both by keys of boxes of a level, sources sorted."""
        out = np.zeros((len(targets), multipoles.shape[1], self.n_check), multipoles.dtype)
        for offset, (t, s) in far_pairs(targets, sources, level).items():  # a target occurs once for an offset
            out[t] += self.one(offset, multipoles[s])
        return out

    def one(self, offset, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class DenseField(FarField):
    @staticmethod
    def piece(ops, level, offset):
        return ops.held(ops.far_matrix(level, offset))

    def one(self, offset, x):
        return x @ self.pieces[offset].T


def _svd(a: np.ndarray, settings: RandomSvd | None):
    if settings is None:
        return np.linalg.svd(a, full_matrices=False)
    if settings.tolerance is not None:
        return linalg.rsvd_to_error(a, settings.tolerance, seed=settings.seed)
    rank = settings.n_components or min(a.shape)
    return linalg.rsvd(a, min(rank, *a.shape), settings.n_oversamples, settings.n_iterations, settings.seed)


class StackedField(FarField):
    """U from all matrices side by side, V from all on top of each other; each core is U^H K V."""

    def __init__(self, ops, level, pieces=None):
        super().__init__(ops, level, pieces)
        full, self.pieces = self.pieces, None
        m = ops.m2l
        u, s, _ = _svd(np.concatenate(list(full.values()), 1), m.svd)
        k = linalg.cutoff_rank(s, m.threshold * s[0]) if m.threshold else len(s)
        _, s2, vh = _svd(np.concatenate(list(full.values()), 0), m.svd)
        k2 = linalg.cutoff_rank(s2, m.threshold * s2[0]) if m.threshold else len(s2)
        self.u, self.vh = u[:, :k], vh[:k2]
        self.core = {}
        for offset, a in full.items():
            core = self.u.conj().T @ a @ self.vh.conj().T
            if m.threshold:
                cu, cs, cv = np.linalg.svd(core, full_matrices=False)
                r = linalg.cutoff_rank(cs, m.threshold * s[0])
                self.core[offset] = (ops.held(cu[:, :r] * cs[:r]), ops.held(cv[:r]))
            else:
                self.core[offset] = (ops.held(core), None)
        self.u, self.vh = ops.held(self.u), ops.held(self.vh)

    def apply(self, multipoles, sources, targets, level):
        small = multipoles @ self.vh.T
        out = np.zeros((len(targets), multipoles.shape[1], self.u.shape[1]), multipoles.dtype)
        for offset, (t, s) in far_pairs(targets, sources, level).items():
            left, right = self.core[offset]
            x = small[s]
            out[t] += (x @ right.T if right is not None else x) @ left.T
        return out @ self.u.T


class PairField(FarField):
    """A left and a right factor for each offset."""

    @staticmethod
    def piece(ops, level, offset):
        m = ops.m2l
        if isinstance(m, Aca):  # rows and columns as they are asked for: the matrix is never formed
            return tuple(map(ops.held, linalg.aca(*kernels.entries(ops.kernel, *ops.far_surfaces(level, offset)), m.eps, seed=m.seed)))
        u, s, vh = _svd(ops.far_matrix(level, offset), m.svd)
        k = linalg.cutoff_rank(s, m.threshold * s[0]) if m.threshold else len(s)
        return ops.held(u[:, :k] * s[:k]), ops.held(vh[:k])

    def one(self, offset, x):
        left, right = self.pieces[offset]
        return x @ right.T @ left.T


class FourierField(FarField):
    """Kernel transforms by offset. Multipoles are embedded in grids; at each frequency the 8 children of a box and those of one of
    its 26 neighbours are an 8 x 8 product, for all pairs of families of a direction at once; then the checks are cut out."""

    @staticmethod
    def piece(ops, level, offset):
        p = ops.order(level)
        size, n = ops.size(level), 2 * p
        target = surfaces.scaled_surface(p, np.zeros(3), size, INNER)[:1]
        values = ops.kernel.matrix(target, surfaces.convolution_grid(p, np.array(offset) * size, size, INNER))[0].reshape(n - 1, n - 1, n - 1)
        whole = np.zeros((n, n, n), values.dtype)
        whole[: n - 1, : n - 1, : n - 1] = values
        return ops.held(linalg.rfft3(linalg.flip3(whole)))

    def cluster(self, direction) -> np.ndarray:
        """(frequencies, source child, target child) of two neighbouring families; 0 where the children touch. Made once a task."""
        if direction not in self.clusters:
            self.clusters[direction] = self._cluster(direction)
        return self.clusters[direction]

    @cached_property
    def clusters(self) -> dict:
        return {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "clusters"}  # tasks make their own

    def _cluster(self, direction) -> np.ndarray:
        one = self.pieces[OFFSETS[0]].ravel()
        out = np.zeros((len(one), 8, 8), one.dtype)
        for i, j in product(range(8), repeat=2):
            offset = tuple((2 * np.array(direction) + CHILDREN[i] - CHILDREN[j]).tolist())
            if offset in self.pieces:
                out[:, i, j] = self.pieces[offset].ravel()
        return out

    def apply(self, multipoles, sources, targets, level):
        p, v, block = self.ops.order(self.level), multipoles.shape[1], max(1, self.ops.m2l.block_size)
        if not len(targets):
            return np.zeros((0, v, self.n_check), multipoles.dtype)
        shape = self.pieces[OFFSETS[0]].shape
        n_freq = int(np.prod(shape))

        def families(keys):
            above, child = parents(keys, level)
            found, row = np.unique(above, return_inverse=True)
            return found, row, child

        theirs, s_row, s_child = families(sources)
        mine, t_row, t_child = families(targets)
        kind = np.result_type(self.ops.dtype, np.complex64)
        hat = np.zeros((n_freq, 8, len(theirs), v), kind)
        for i in range(0, len(multipoles), block):
            grids = linalg.rfft3(surfaces.charges_on_grid(p, multipoles[i : i + block])).reshape(-1, v, n_freq)
            hat[:, s_child[i : i + block], s_row[i : i + block]] = grids.transpose(2, 0, 1)
        out = np.zeros((n_freq, 8, len(mine), v), kind)
        for direction, (t, s) in neighbour_pairs(mine, theirs, level - 1).items():
            out[:, :, t] += linalg.hadamard8x8(self.cluster(direction), hat[:, :, s].reshape(n_freq, 8, -1)).reshape(n_freq, 8, len(t), v)
        parts = []
        for i in range(0, len(targets), block):
            grids = out[:, t_child[i : i + block], t_row[i : i + block]].transpose(1, 2, 0).reshape(-1, v, *shape)
            parts.append(surfaces.checks_from_grid(p, linalg.irfft3(grids, 2 * p, not self.ops.kernel.complex)))
        return np.concatenate(parts)


# ---- boxes as arrays -------------------------------------------------------------------------------------------------


def centres(keys: np.ndarray, level: int, origin, side: float) -> np.ndarray:
    return (grid(keys, level) + 0.5) * (side / 2**level) + np.asarray(origin)


def neighbour_pairs(targets: np.ndarray, sources: np.ndarray, level: int) -> dict:
    """direction to (target rows, source rows) of boxes that are neighbours; sources sorted by key."""
    if not len(targets) or not len(sources):
        return {}
    at, limit, out = grid(targets, level), 1 << level, {}
    for direction in DIRECTIONS:
        other = at + np.array(direction)
        t = np.flatnonzero(((other >= 0) & (other < limit)).all(1))
        found = key_of(other[t], level)
        near = np.minimum(np.searchsorted(sources, found), len(sources) - 1)
        hit = sources[near] == found
        if hit.any():
            out[direction] = t[hit], near[hit]
    return out


def far_pairs(targets: np.ndarray, sources: np.ndarray, level: int) -> dict:
    """offset to (target rows, source rows) of the V list; sources sorted by key."""
    if not len(targets) or not len(sources):
        return {}
    at, limit = grid(targets, level), 1 << level
    out = {}
    for offset in OFFSETS:
        other = at + np.array(offset)
        ok = ((other >= 0) & (other < limit)).all(1) & (np.abs((other >> 1) - (at >> 1)) <= 1).all(1)
        t = np.flatnonzero(ok)
        if len(t):
            found = key_of(other[t], level)
            near = np.minimum(np.searchsorted(sources, found), len(sources) - 1)
            hit = sources[near] == found
            if hit.any():
                out[offset] = t[hit], near[hit]
    return out


def seen(key: int) -> dict[int, np.ndarray]:
    """The boxes of the far lists of a box and of those above it, by level from 2 down, sorted."""
    out, level = {}, key & 0x7FFF
    while level >= 2:
        at, limit = grid(np.array([key]), level)[0], 1 << level
        other = at + np.array(OFFSETS)
        ok = ((other >= 0) & (other < limit)).all(1) & (np.abs((other >> 1) - (at >> 1)) <= 1).all(1)
        out[level] = np.sort(key_of(other[ok], level))
        (key,), _ = parents(np.array([key]), level)
        level -= 1
    return dict(sorted(out.items()))


def parents(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Parent keys and child numbers."""
    low = 15 + 3 * (16 - level)
    return keys >> (low + 3) << (low + 3) | (level - 1), (keys >> low & 7).astype(np.int64)


def up(ops: Operators, keys: np.ndarray, multipoles: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents' keys (sorted) and multipoles (n, vecs, coefficients)."""
    above, child = parents(keys, level)
    found, row = np.unique(above, return_inverse=True)
    out = np.zeros((len(found), multipoles.shape[1], ops.n_coeffs(level - 1)), multipoles.dtype)
    m2m = ops.m2m(level)
    for c in range(8):
        mine = child == c
        if mine.any():
            out[row[mine]] += multipoles[mine] @ m2m[c].T
    return found, out


def down(ops: Operators, keys: np.ndarray, level: int, above: np.ndarray, locals_: np.ndarray) -> np.ndarray:
    """Locals of boxes from their parents' (above sorted; a missing parent gives 0)."""
    parent, child = parents(keys, level)
    out = np.zeros((len(keys), locals_.shape[1], ops.n_coeffs(level)), locals_.dtype)
    if not len(above):
        return out
    row = np.minimum(np.searchsorted(above, parent), len(above) - 1)
    known = above[row] == parent
    l2l = ops.l2l(level)
    for c in range(8):
        mine = known & (child == c)
        if mine.any():
            out[mine] = locals_[row[mine]] @ l2l[c].T
    return out
