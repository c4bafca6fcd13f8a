"""Whitening of embeddings by a two-pass covariance.

Entries c become integers x = floor(256 c). The fit list is each distinct x vector once. The first pass sums it exactly in integers, which gives
the mean; the second sums centred outer products, a NumPy GEMM over blocks of vectors in each task. Both merge one small partial a task by
``treeAggregate``, so the driver gets a few matrices however many tasks there are. LAPACK's symmetric eigensolver gives the components; mean and
projection, a few numbers for each dimension, are broadcast, and all rows are projected. A last pass over the fit list
measures how far the whitened vectors' covariance is from the identity.

Rows whose vector is null or holds a null, NaN or infinite entry are dropped. Vectors of different lengths are an error. Vectors
of no entries have no components, and an empty table gives no rows. A null id is kept. Rows that repeat a vector or an id have rows of their own.
Components along which nothing varies (eigenvalue 0 up to rounding) have null ``whitened``; where nothing varies at all ``explained`` and
``identity_error`` are null too. Entries beyond a 64-bit x are clipped to its range; a deviation beyond it is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import small_batches, stored

#: Components returned.
COMPONENTS = 4
#: Vectors of a GEMM.
BLOCK = 4096
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list, eigenvalues (falling), components (rows, unit vectors), the trace and the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of each entry; null for a vector that is null or holds a null, NaN or infinite entry."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    wide = F.transform(vector, lambda c: c.cast("double"))
    return F.when(F.forall(wide, sound), F.transform(wide, lambda c: F.floor(c * scale).cast("long")))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, whatever their size."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return [int(v) for v in (x if largest * max(1, len(x)) < _SAFE else x.astype(object)).sum(0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the exact integers n x - S."""
    return scaled_difference(x, n, sums).astype(float) / n


def scaled_difference(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S: 64-bit where that is exact, Python integers elsewhere."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if n * largest + max(map(abs, sums), default=0) < _SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2 by row, exact; None beyond 64 bits."""
    d = scaled_difference(x, n, sums)
    largest = max(abs(int(d.min())), abs(int(d.max()))) if d.size else 0
    total = ((d if largest * largest * max(1, d.shape[1]) < _SAFE else d.astype(object)) ** 2).sum(1)
    return [int(v) if int(v) < 1 << 63 else None for v in total]


def _by_tasks(fit: DataFrame, partial, merged, depth: int = 2):
    """``partial`` of each task's vectors (an iterator of matrices), merged by treeAggregate; None without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        blocks = (x[i : i + BLOCK] for x in map(_matrix, batches) for i in range(0, len(x), BLOCK))
        made = partial(blocks)
        yield pa.RecordBatch.from_arrays([pa.array([] if made is None else [pickle.dumps(made)], pa.binary())], names=["made"])

    def add(a, b):
        import pickle

        b = pickle.loads(b["made"]) if isinstance(b, tuple) and hasattr(b, "made") else b
        return b if a is None else a if b is None else merged(a, b)

    return fit.select("x").mapInArrow(run, "made binary").rdd.treeAggregate(None, add, add, depth)


def _counts(blocks: Iterator[np.ndarray]):
    n, sums = 0, None
    for x in blocks:
        n += len(x)
        mine = exact_sums(x)
        sums = mine if sums is None else [a + b for a, b in zip(sums, mine, strict=True)]
    return (n, sums) if n else None


def _products(n: int, sums: list[int], project: np.ndarray | None = None):
    def run(blocks: Iterator[np.ndarray]):
        total = None
        for x in blocks:
            y = centred(x, n, sums)
            y = y if project is None else y @ project
            total = y.T @ y if total is None else total + y.T @ y
        return total

    return run


def eigen(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (0 where rounding is all there is), falling, and unit vectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    noise = len(covariance) * np.finfo(float).eps * max(values[0], 0.0)
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
    return np.where(values > noise, values, 0.0), vectors * np.where(largest < 0, -1.0, 1.0)[:, None]


def fitted(fit: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct vectors ``x`` (stored: it is read three times); None if there are none or they are empty."""
    known = fit.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if known["low"] != known["high"]:
        raise ValueError(f"vectors of different lengths: {known['low']} to {known['high']}")
    if not known["high"]:
        return None
    n, sums = _by_tasks(fit, _counts, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]))
    covariance = _by_tasks(fit, _products(n, sums), np.add) / n
    values, components = eigen(covariance, k)
    trace, used = float(np.trace(covariance)), values > 0
    if not used.any():
        return Whitening(n, sums, values, components, trace)
    scale = components[used].T / np.sqrt(values[used])
    measured = _by_tasks(fit, _products(n, sums, scale), np.add) / n
    return Whitening(n, sums, values, components, trace, float(np.abs(measured - np.eye(len(measured))).max()))


def whitened(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component up to k."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col(column)).alias("x")).filter("x is not null")
    model = fitted(stored(rows.select("x").distinct(), "whitening-fit"), k)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # k + 1 numbers for each dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        used = m.values > 0
        scale = m.components.T / np.sqrt(np.where(used, m.values, 1.0))
        k = len(m.values)
        share = [float(v / m.trace) if m.trace > 0 else None for v in m.values]
        for batch in batches:
            x = _matrix(batch)
            if not len(x):
                continue
            y = centred(x, m.n, m.sums) @ scale
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n, np.int64)),
                    pa.array([v for v in deviations(x, m.n, m.sums) for _ in range(k)], pa.int64()),
                    pa.array(y.reshape(-1), mask=np.tile(~used, rows)),
                    pa.array(share * rows, pa.float64()),
                    pa.array([m.identity_error] * (rows * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
