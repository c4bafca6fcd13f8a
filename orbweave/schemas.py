"""Fixed schemas of the engine's tables, and checks of the tables callers bring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("gid", T.LongType(), False), *[T.StructField(c, T.DoubleType(), False) for c in "xyz"]])
CHARGES = T.StructType([T.StructField("gid", T.LongType(), False), T.StructField("vec_idx", T.IntegerType(), False), T.StructField("q", T.DoubleType(), False), T.StructField("q_im", T.DoubleType(), True)])
BOXES = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("level", T.IntegerType(), False), T.StructField("parent", T.LongType(), True), T.StructField("is_leaf", T.BooleanType(), False), T.StructField("n_points", T.LongType(), False)])
EXPANSIONS = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("level", T.IntegerType(), False), T.StructField("vec_idx", T.IntegerType(), False), T.StructField("coeff", T.ArrayType(T.DoubleType()), False), T.StructField("coeff_im", T.ArrayType(T.DoubleType()), True)])

#: Largest tree depth: keys hold 16 bits an axis and 15 bits of level.
MAX_DEPTH = 16


def points(df: DataFrame) -> DataFrame:
    """gid, x, y, z as doubles; a null or NaN coordinate is an error when it is read."""
    missing = {"gid", "x", "y", "z"} - set(df.columns)
    if missing:
        raise ValueError(f"points lack {sorted(missing)}: they are three-dimensional, one row each")
    sound = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.raise_error(F.lit("point without coordinates")).cast("double")).otherwise(F.col(c).cast("double")).alias(c) for c in "xyz"]
    return df.select(F.col("gid").cast("long").alias("gid"), *sound)


def counted(df: DataFrame, name: str) -> int:
    """How many rows df has, once their gids are known to be there and different."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("gid").alias("ids")).first()
    if found["rows"] != found["ids"]:
        raise ValueError(f"{name} need different gids, none of them null: {found['rows']} rows have {found['ids']}")
    return found["rows"]


def unique(df: DataFrame, name: str) -> DataFrame:
    """df, once its gids are known to be there and different."""
    counted(df, name)
    return df


def charged(sources: DataFrame, charges: DataFrame) -> DataFrame:
    """sources with vec_idx, q, q_im, a row for each of their charges (of a gid and vec_idx they add up). A source without a charge is an
    error when it is read; charges of no source are left out."""
    q = F.coalesce("q", F.raise_error(F.lit("source without a charge")).cast("double"))
    return sources.join(charges.select("gid", "vec_idx", "q", "q_im"), "gid", "left").withColumn("q", q)


def charges(df: DataFrame) -> DataFrame:
    """gid, vec_idx, q, q_im; a missing vec_idx is right-hand side 0, a missing q_im is 0."""
    if not {"gid", "q"} <= set(df.columns):
        raise ValueError("charges need gid and q")
    return df.select(
        F.col("gid").cast("long").alias("gid"),
        (F.col("vec_idx") if "vec_idx" in df.columns else F.lit(0)).cast("int").alias("vec_idx"),
        F.col("q").cast("double").alias("q"),
        F.coalesce((F.col("q_im") if "q_im" in df.columns else F.lit(0.0)).cast("double"), F.lit(0.0)).alias("q_im"),
    )
