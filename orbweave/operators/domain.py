"""Cubic domains of point sets: one aggregation each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = 0.005


@dataclass(frozen=True)
class Domain:
    origin: tuple[float, float, float]
    side: float

    def union(self, other: Domain) -> Domain:
        """Smallest cube from the lower origins that holds both; no further padding."""
        low = tuple(min(a, b) for a, b in zip(self.origin, other.origin, strict=True))
        top = [max(a + self.side, b + other.side) for a, b in zip(self.origin, other.origin, strict=True)]
        return Domain(low, max(t - o for t, o in zip(top, low, strict=True)))


def extents(points: DataFrame) -> DataFrame:
    """One row: the padded cube ox, oy, oz, side."""
    span = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
    found = points.agg(*[F.min(c).alias(f"o{c}") for c in "xyz"], span.alias("side"))
    return found.select(*[(F.col(f"o{c}") - F.col("side") * PAD).alias(f"o{c}") for c in "xyz"], (F.col("side") * (1 + 2 * PAD)).alias("side"))


def domain_of(points: DataFrame) -> Domain:
    row = extents(points).first()
    if row is None or row["side"] is None:
        raise ValueError("no points")
    if row["side"] == 0:  # a single place
        return Domain(tuple(row[f"o{c}"] - 0.5 for c in "xyz"), 1.0)
    return Domain(tuple(row[f"o{c}"] for c in "xyz"), row["side"])


def corners(points: DataFrame) -> DataFrame:
    """The 8 corners x, y, z of the points' bounding box, x fastest."""
    box = points.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))])
    at = F.explode(F.sequence(F.lit(0), F.lit(7)))
    bit = lambda c, i: F.when(F.col("corner").bitwiseAND(1 << i) > 0, F.col(f"b{c}")).otherwise(F.col(f"a{c}"))
    return box.withColumn("corner", at).select("corner", bit("x", 0).alias("x"), bit("y", 1).alias("y"), bit("z", 2).alias("z"))
