"""Balanced adaptive octrees as tables: one set of leaves, on several levels, for sources and targets together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import morton as M
from orbweave.operators import keysets as K
from orbweave.operators.domain import Domain
from orbweave.operators.trees import Tree, keyed
from orbweave.plans.storage import stored
from orbweave.schemas import MAX_DEPTH

#: Rows of keys up to which a side of a join is broadcast.
BROADCAST_KEYS = 500_000
#: Levels that one aggregation refines.
STEP = 4


@dataclass
class AdaptiveTree(Tree):
    """A tree whose leaves are on several levels; ``depth`` is the deepest. Boxes are the occupied leaves and what is above them."""


def sized(keys: DataFrame) -> DataFrame:
    """Stored rows of keys with a broadcast hint if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def refined(points: DataFrame, n_crit: int) -> DataFrame:
    """key: the leaves of the whole domain when boxes of more than ``n_crit`` points are split (down to the deepest level). points: base_key.

    Points are counted by deepest box once. A box holds at least what a box in it holds, so the crowded ones of several levels are found in one
    aggregation; only what lies in crowded boxes of the last of them goes on.
    """
    cells = stored(points.groupBy("base_key").agg(F.count(F.lit(1)).alias("n")), "cells")
    root = points.sparkSession.range(1).select(F.lit(M.ROOT).cast("long").alias("key"))
    crowded = None
    for first in range(0, MAX_DEPTH, STEP):
        last = min(first + STEP, MAX_DEPTH) - 1
        boxes = cells.select(F.explode(F.array(*[M.at_level(F.col("base_key"), lev) for lev in range(first, last + 1)])).alias("key"), "n")
        found = stored(boxes.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > n_crit).select("key"), "crowded-boxes")
        crowded = found if crowded is None else crowded.union(found)
        deep = found.filter(M.level(F.col("key")) == last)
        many = deep.count()
        if not many:
            break
        deep = F.broadcast(deep) if many <= BROADCAST_KEYS else deep
        cells = stored(cells.withColumn("key", M.at_level(F.col("base_key"), last)).join(deep, "key", "left_semi").select("base_key", "n"), "cells")
    return root.union(crowded.select(F.explode(M.children(F.col("key"))).alias("key"))).join(sized(crowded), "key", "left_anti")


def placed(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """points (with base_key) and the leaf_key of the leaf that holds each. Leaves don't overlap: a point's boxes of their levels meet one."""
    levels = sorted(r[0] for r in leaves.select(M.level(F.col("key"))).distinct().collect())
    points = points.drop("leaf_key")
    above = points.withColumn("leaf_key", F.explode(F.array(*[M.at_level(F.col("base_key"), lev) for lev in levels])))
    return above.join(sized(leaves.select(F.col("key").alias("leaf_key"))), "leaf_key").select(*points.columns, "leaf_key")


def boxes_above(counts: DataFrame) -> DataFrame:
    """key, level, parent, is_leaf, n_points of occupied leaves (key, n_points) and all boxes above them."""
    inner = counts.filter(M.level(F.col("key")) > 0).select(F.explode(M.ancestors(M.parent(F.col("key")))).alias("key")).distinct()
    rows = counts.select("key", F.lit(True).alias("is_leaf"), "n_points").union(inner.select("key", F.lit(False), F.lit(0).cast("long")))
    return rows.select("key", M.level(F.col("key")).alias("level"), M.parent(F.col("key")).alias("parent"), "is_leaf", "n_points")


def build(sources: DataFrame, targets: DataFrame, n_crit: int, domain: Domain) -> tuple[AdaptiveTree, AdaptiveTree]:
    """Trees of both sets over the same balanced leaves: a leaf holds at most ``n_crit`` points of both sets together, but at the deepest level,
    and leaves that touch are at most one level apart. Points, boxes and leaves are stored."""
    if n_crit < 1:
        raise ValueError("n_crit is 1 or more")
    based = [keyed(schemas.points(p), domain, 0).drop("leaf_key") for p in (sources, targets)]
    leaves = stored(K.balance(refined(based[0].select("base_key").union(based[1].select("base_key")), n_crit)), "balanced-leaves")
    trees = []
    for points, name in zip(based, ("source", "target"), strict=True):
        points = schemas.unique(stored(placed(points, leaves), f"{name}-points"), f"{name} points")
        counts = points.groupBy(F.col("leaf_key").alias("key")).agg(F.count(F.lit(1)).alias("n_points"))
        trees.append((points, stored(boxes_above(counts), f"{name}-boxes")))
    depth = trees[0][1].union(trees[1][1]).agg(F.max("level")).first()[0] or 0
    return tuple(AdaptiveTree(points, boxes, domain, depth) for points, boxes in trees)
