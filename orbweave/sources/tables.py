"""Point sets derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings(spark: SparkSession, sf_dir: str, first: int = 1) -> DataFrame:
    """gid, x, y, z, q from three consecutive components of the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = [F.element_at("embedding", first + i).cast("double").alias(c) for i, c in enumerate("xyz")]
    return rows.select(F.col("vec_id").alias("gid"), *at, (F.lit(1.0) + F.col("label")).alias("q"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(F.col("p_partkey").alias("gid"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_retailprice").cast("double") - 900.0) / 100.0).alias("y"), ((F.col("p_partkey") * 7919 % 1009) / 1009.0).alias("z"), F.lit(1.0).alias("q"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, without ids of their own: for queries that need none."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select((F.col("l_quantity").cast("double") / 50.0).alias("x"), (F.col("l_extendedprice").cast("double") / 105000.0).alias("y"), (F.col("l_discount").cast("double") * 10.0).alias("z"), F.col("l_tax").cast("double").alias("q"))
