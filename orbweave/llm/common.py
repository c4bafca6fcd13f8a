"""Shared pieces of the corpus operators: stored intermediates, size-checked broadcasts and vectorised UTF-8 work.

Python stages get Arrow batches and work on the UTF-8 bytes of a whole batch of texts at once with numpy. ``pieces``
splits a batch so that one piece holds about ``PIECE_BYTES`` bytes (a longer text is a piece of its own), which
bounds the memory of a Python worker whatever the batch size is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 2 << 20
#: Rows up to which a side of (id, small value) rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


# ---- stored intermediates ------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session on one machine that has none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="orbweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint if ``df`` (a stored frame of narrow rows) is known to be small; otherwise ``df`` as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold at most ``BATCH_ROWS`` rows from then on: batches of many long rows would fill an executor's
    memory beside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and other string columns, for a Python stage, in ``small_batches``."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", *more)])


def held_out(doc_id: Column) -> Column:
    """Fold 1 of 3 by CRC-32 of the id as text; a null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


# ---- bytes ---------------------------------------------------------------------------------------------------------

#: Separators by byte value.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of lower-cased alphanumeric words; bytes of non-ASCII characters belong to words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * U(_STEP))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base modulo 2**64, and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        back = pow(_STEP | 1, -1, 1 << 64)
        for name, base in (("_powers", _STEP | 1), ("_inverse", back)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=np.uint64)
    return _powers, _inverse


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans get equal hashes wherever they lie."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive members of h, by first member; the last k - 1 have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * (_STEP | 1) & ((1 << 64) - 1)
        out += h[j : j + n] * U(factor)
    return _mixed(out + U(k))


def gram_hashes_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``gram_hashes`` of the k members from each position in ``at``."""
    out = np.full(len(at), k, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * (_STEP | 1) & ((1 << 64) - 1)
        out += h[at + j] * U(factor)
    return _mixed(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts, with the end."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, name: str = "text", size: int | None = None) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with the text column, nulls as empty text; of about ``size`` bytes (``PIECE_BYTES`` by default)."""
    size = size or PIECE_BYTES
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words of a piece: ``start``/``end`` byte positions, ``first`` word number of each text (with the end).

    ``also`` gives the positions of further separators, by the bytes and where texts start.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        data, at = utf8(column)
        self.data, self.at = (LOWER[data] if lower else data), at
        inside = ~separators[self.data]
        if also:
            inside[also(self.data, at)] = False
        edge = np.empty(len(inside) + 1, bool)
        edge[0], edge[-1] = True, True
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[at] = True
        # a text border inside a run of word bytes ends one word and starts another
        self.start = np.flatnonzero(inside & edge[:-1])
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.start, at)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def text_of(self, counts_at: np.ndarray | None = None) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
