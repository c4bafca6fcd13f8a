"""Dense ranks without a single-task sort: range partitions, their sizes, and ranks within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.plans.storage import stored


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ``name``: 0, 1, ... in a total order. The partitioned rows are stored, so a retried task can't deal them anew."""
    placed = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + inside - 1).drop("_part", "_before")
