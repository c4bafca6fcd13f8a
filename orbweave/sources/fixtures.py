"""Seeded point sets as distributed generators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.ranking import ranked


def _uniform(i: int, seed: int):
    return F.rand(seed * 7919 + i)


def uniform(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """gid, x, y, z uniform in [low, high)^3."""
    return spark.range(n).select(F.col("id").alias("gid"), *[(F.lit(low) + _uniform(i, seed) * (high - low)).alias(c) for i, c in enumerate("xyz")])


def column(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """x, y in [0, 0.1), z in [0, 500)."""
    return spark.range(n).select(F.col("id").alias("gid"), (_uniform(0, seed) * 0.1).alias("x"), (_uniform(1, seed) * 0.1).alias("y"), (_uniform(2, seed) * 500).alias("z"))


def spheroid(spark: SparkSession, n: int, a: float, c: float, seed: int = 0) -> DataFrame:
    """On the surface of an oblate spheroid with semi-axes a (x, y) and c (z), by uniform angles."""
    rows = spark.range(n).select(F.col("id").alias("gid"), (_uniform(0, seed) * 2 * math.pi).alias("phi"), F.acos(_uniform(1, seed) * 2 - 1).alias("theta"))
    return rows.select("gid", (a * F.sin("theta") * F.cos("phi")).alias("x"), (a * F.sin("theta") * F.sin("phi")).alias("y"), (c * F.cos("theta")).alias("z"))


def sphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """On the unit sphere."""
    return spheroid(spark, n, 1.0, 1.0, seed)


def unit_charges(points: DataFrame, n_vecs: int = 1) -> DataFrame:
    """gid, vec_idx, q = 1 + vec_idx."""
    return points.select("gid", F.explode(F.sequence(F.lit(0), F.lit(n_vecs - 1))).alias("vec_idx")).withColumn("q", F.lit(1.0) + F.col("vec_idx"))


def dense_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``gid``: 0, 1, ... in the given total order."""
    return ranked(rows, order, "gid")
