"""Surface points of boxes as rows: a small grid exploded over the boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import morton as M
from orbweave.functions import surfaces


def box_surfaces(keys: DataFrame, domain, p: int, alpha: float) -> DataFrame:
    """key, point, x, y, z: the surface of each box of ``keys`` at scale alpha, points numbered in grid order."""
    grid = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(row, "xyz", strict=True)]) for row in surfaces.surface_grid(p)])
    half = M.diameter(F.col("key"), domain.side) * (alpha / 2)
    rows = keys.select("key", *[c.alias(f"c{n}") for c, n in zip(M.centre(F.col("key"), domain), "xyz", strict=True)], half.alias("half"), F.posexplode(grid).alias("point", "g"))
    return rows.select("key", "point", *[(F.col(f"c{c}") + F.col("half") * F.col("g")[c]).alias(c) for c in "xyz"])
