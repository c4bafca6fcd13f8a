"""Connected components of an edge table by alternating hooking and pointer jumping on stored tables.

Nulls in an edge link nothing; loops and repeated edges change nothing; ties go to the smaller node. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import forget, stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges a, b (long).

    Each round keeps for every node the smallest label among its neighbours' and its own label's label, so labels
    travel at least twice as far each round; it ends when no label changes. Hot nodes are pre-aggregated by ``min``.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = stored(both, f"{label}-edges")
    now = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{label}-roots")
    while True:
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("root").alias("near"))
        hooked = now.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("up"))
        up = now.select(F.col("node").alias("up"), F.col("root").alias("top"))
        step = hooked.join(up, "up").select("node", F.col("root").alias("was"), F.least("up", "top").alias("root"))
        step = stored(step, f"{label}-roots")
        moved = step.filter("was != root").limit(1).count()
        forget(now)
        now = step.select("node", "root")
        if not moved:
            forget(both)
            return now
