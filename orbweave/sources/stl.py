"""Vertices of STL meshes (binary or ASCII) as points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.ranking import ranked

_TRIANGLE = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("extra", "<u2")])


def corners(content: bytes) -> np.ndarray:
    """(triangles, 3, 3) coordinates of one file."""
    count = int.from_bytes(content[80:84], "little") if len(content) >= 84 else -1
    if count >= 0 and len(content) == 84 + count * _TRIANGLE.itemsize:
        return np.frombuffer(content, _TRIANGLE, count, 84)["corners"].astype(float)
    found = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", content)
    return np.array(found, dtype="S32").astype(float).reshape(-1, 3, 3)


#: Triangles of an Arrow batch.
BATCH = 50_000


def _triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, face, x, y, z: a row for each corner of each triangle."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = corners(content)
            for lo in range(0, len(found), BATCH):
                part = found[lo : lo + BATCH].reshape(-1, 3)
                faces = np.repeat(np.arange(lo, lo + len(part) // 3), 3)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(faces, pa.int64()), *[pa.array(part[:, i]) for i in range(3)]], names=["path", "face", "x", "y", "z"])


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """path, gid, x, y, z, faces: the distinct vertices of each mesh file, numbered by place, and the triangles they belong to.

    A file is read in one task (Spark's binary files, of at most 2 GB), in batches of triangles; equal corners meet in a shuffle and are
    numbered by range partitions, so that nothing but a file's bytes is ever in one task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_triangles, "path string, face long, x double, y double, z double")
    vertices = rows.groupBy("path", "x", "y", "z").agg(F.array_sort(F.collect_set("face")).alias("faces"))
    placed = ranked(vertices, ["path", "x", "y", "z"], "place")
    first = F.broadcast(placed.groupBy("path").agg(F.min("place").alias("first")))  # a row for each file
    return placed.join(first, "path").select("path", (F.col("place") - F.col("first")).alias("gid"), "x", "y", "z", "faces")
