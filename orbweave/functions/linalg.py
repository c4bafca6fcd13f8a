"""Dense numerical kernels (numpy): pseudo-inverses, randomised SVD, adaptive cross approximation, Fourier transforms."""

from __future__ import annotations

import numpy as np


def relative_error(found: np.ndarray, exact: np.ndarray) -> float:
    """sqrt(sum |f - e|^2 / sum |e|^2)."""
    return float(np.sqrt((np.abs(found - exact) ** 2).sum() / (np.abs(exact) ** 2).sum()))


def pinv(a: np.ndarray, atol: float = 0.0, rtol: float | None = None, mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Factors (left, right) with left @ right the pseudo-inverse; kept apart, they lose less to rounding.

    Singular values up to (atol + rtol) * largest go (``mixed``), or up to atol + rtol * largest. rtol: max(shape) * eps.
    """
    rtol = max(a.shape) * np.finfo(a.real.dtype).eps if rtol is None else rtol
    u, s, vh = np.linalg.svd(a, full_matrices=False)
    cut = (atol + rtol) * s[0] if mixed else atol + rtol * s[0]
    keep = s > cut
    inverse = np.zeros_like(s)
    inverse[keep] = 1 / s[keep]
    return vh.conj().T * inverse, u.conj().T


def cutoff_rank(s: np.ndarray, threshold: float) -> int:
    """How many leading singular values exceed the threshold, 1 at least."""
    return max(1, int((s > threshold).sum()))


def rsvd(a: np.ndarray, rank: int, oversamples: int = 10, power: int = 0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Randomised SVD of fixed rank, with QR-stabilised power iterations."""
    rng = np.random.default_rng(seed)
    k = min(rank + oversamples, *a.shape)
    q = np.linalg.qr(a @ rng.standard_normal((a.shape[1], k)))[0]
    for _ in range(power):
        q = np.linalg.qr(a.conj().T @ q)[0]
        q = np.linalg.qr(a @ q)[0]
    u, s, vh = np.linalg.svd(q.conj().T @ a, full_matrices=False)
    return (q @ u)[:, :rank], s[:rank], vh[:rank]


def rsvd_to_error(a: np.ndarray, tolerance: float, block: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Randomised SVD by an adaptive range finder: fresh random vectors are added until the rest's norm is below tolerance."""
    rng = np.random.default_rng(seed)
    q = np.zeros((a.shape[0], 0), a.dtype)
    rest = a.copy()
    while q.shape[1] < min(a.shape) and np.linalg.norm(rest, 2) > tolerance:
        y = rest @ rng.standard_normal((a.shape[1], min(block, min(a.shape) - q.shape[1])))
        q = np.linalg.qr(np.concatenate([q, y], 1))[0]
        rest = a - q @ (q.conj().T @ a)
    u, s, vh = np.linalg.svd(q.conj().T @ a, full_matrices=False)
    return q @ u, s, vh


def aca(rows, columns, shape: tuple[int, int], eps: float, max_rank: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Partially pivoted cross approximation with a reference row and column: a ~ u @ v, never forming a.

    rows(i) and columns(j) give single rows and columns. The next pivot comes from the larger of the residual row's
    and column's reference entries. Stops when the last cross is below eps times the first.
    """
    m, n = shape
    max_rank = min(m, n) if max_rank is None else max_rank
    rng = np.random.default_rng(seed)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    used_i, used_j = np.zeros(m, bool), np.zeros(n, bool)
    row = lambda i: rows(i) - sum((u[i] * v for u, v in zip(us, vs, strict=True)), np.zeros(n))
    col = lambda j: columns(j) - sum((v[j] * u for u, v in zip(us, vs, strict=True)), np.zeros(m))
    ref_i, ref_j = int(rng.integers(m)), int(rng.integers(n))
    ref_row, ref_col = row(ref_i), col(ref_j)
    first = None
    while len(us) < max_rank:
        in_row, in_col = np.where(used_j, 0, np.abs(ref_row)), np.where(used_i, 0, np.abs(ref_col))
        if in_row.max() > in_col.max():
            j = int(in_row.argmax())
            c = col(j)
            i = int(np.where(used_i, 0, np.abs(c)).argmax())
            r = row(i)
        else:
            i = int(in_col.argmax())
            r = row(i)
            j = int(np.where(used_j, 0, np.abs(r)).argmax())
            c = col(j)
        pivot = r[j]
        if abs(pivot) == 0:
            break
        size = float(np.linalg.norm(c) * np.linalg.norm(r) / abs(pivot))
        first = size if first is None else first
        us.append(c / pivot)
        vs.append(r)
        used_i[i], used_j[j] = True, True
        if size <= eps * first:
            break
        ref_row = ref_row - us[-1][ref_i] * vs[-1]
        ref_col = ref_col - vs[-1][ref_j] * us[-1]
        if i == ref_i and not used_i.all():
            ref_i = int(rng.choice(np.flatnonzero(~used_i)))
            ref_row = row(ref_i)
        if j == ref_j and not used_j.all():
            ref_j = int(rng.choice(np.flatnonzero(~used_j)))
            ref_col = col(ref_j)
    if not us:
        return np.zeros((m, 1)), np.zeros((1, n))
    return np.stack(us, 1), np.stack(vs, 0)


def pinv_aca(a, eps: float = 1e-13, rtol: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-inverse factors by cross approximation, QR of both factors and the SVD of the small core. ``a`` is a matrix, or its rows, columns
    and shape as ``aca`` takes them: then it is never formed."""
    rows, columns, shape = a if isinstance(a, tuple) else (lambda i: a[i], lambda j: a[:, j], a.shape)
    u, v = aca(rows, columns, shape, eps)
    qu, ru = np.linalg.qr(u)
    qv, rv = np.linalg.qr(v.conj().T)
    left, right = pinv(ru @ rv.conj().T, rtol=rtol)
    return qv @ left, right @ qu.conj().T


def flip3(a: np.ndarray) -> np.ndarray:
    """All three axes reversed."""
    return a[::-1, ::-1, ::-1]


def rfft3(a: np.ndarray) -> np.ndarray:
    """Of the last three axes: real (n, n, n) to (n, n, n // 2 + 1), complex to (n, n, n)."""
    return np.fft.fftn(a, axes=(-3, -2, -1)) if np.iscomplexobj(a) else np.fft.rfftn(a, axes=(-3, -2, -1))


def irfft3(a: np.ndarray, n: int, real: bool = True) -> np.ndarray:
    """The inverse, divided by the number of points."""
    return np.fft.irfftn(a, s=(n, n, n), axes=(-3, -2, -1)) if real else np.fft.ifftn(a, axes=(-3, -2, -1))


def hadamard8x8(matrices: np.ndarray, vectors: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """result[f, j, n] = scale * sum_i matrices[f, i, j] * vectors[f, i, n]: 8 siblings to 8 siblings at each frequency, for n families."""
    made = matrices.swapaxes(1, 2) @ vectors
    return made if scale == 1 else scale * made
