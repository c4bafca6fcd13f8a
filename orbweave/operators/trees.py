"""Uniform octrees as tables: points with leaf keys, and boxes with levels, parents and point counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import morton as M
from orbweave.operators.domain import Domain, domain_of
from orbweave.operators.ranking import ranked
from orbweave.schemas import MAX_DEPTH

SORTS = ("samplesort", "hyksort", "simplesort")


@dataclass
class Tree:
    """points: gid, x, y, z, base_key, leaf_key. boxes: key, level, parent, is_leaf, n_points."""

    points: DataFrame
    boxes: DataFrame
    domain: Domain
    depth: int

    # lookups
    def root(self) -> int:
        return M.ROOT

    def leaves(self) -> DataFrame:
        return self.boxes.filter("is_leaf")

    def n_leaves(self) -> int:
        return self.leaves().count()

    def keys(self, level: int | None = None) -> DataFrame:
        return self.boxes if level is None else self.boxes.filter(F.col("level") == level)

    def n_keys(self, level: int | None = None) -> int:
        return self.keys(level).count()

    def leaf_points(self, leaf: int) -> DataFrame:
        return self.points.filter(F.col("leaf_key") == leaf)

    coordinates = leaf_points

    def n_coordinates(self, leaf: int | None = None) -> int:
        return (self.points if leaf is None else self.leaf_points(leaf)).count()

    def global_indices(self) -> DataFrame:
        """gid in tree order, with its rank."""
        return ranked(self.points.select("gid", "leaf_key"), ["leaf_key", "gid"], "rank").select("gid", (F.col("rank") + 1).alias("rank"))

    def indexed(self) -> DataFrame:
        """boxes with index (by level, key), level_index and leaf_index (0-based; null for inner boxes)."""
        sizes = self.boxes.groupBy("level").agg(F.count(F.lit(1)).alias("n"))  # at most 17 rows
        before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("level", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
        made = ranked(self.boxes, ["level", "key"], "index").join(F.broadcast(starts), "level")
        made = made.withColumn("level_index", F.col("index") - F.col("_start")).drop("_start")
        return made.withColumn("leaf_index", F.when(F.col("is_leaf"), F.col("level_index")))

    def node(self, index: int) -> int | None:
        row = self.indexed().filter(F.col("index") == index).first()
        return row["key"] if row else None


def keyed(points: DataFrame, domain: Domain, depth: int) -> DataFrame:
    """points with base_key (deepest level) and leaf_key."""
    based = points.withColumn("base_key", M.from_point(F.col("x"), F.col("y"), F.col("z"), domain, MAX_DEPTH))
    return based.withColumn("leaf_key", M.at_level(F.col("base_key"), depth))


def boxes_of(leaves: DataFrame, depth: int, prune: bool, counts: DataFrame) -> DataFrame:
    """The tree's boxes from its occupied leaves (key). counts: key, n_points of leaves."""
    spark = leaves.sparkSession
    if prune:
        family = leaves.select(F.explode(M.siblings(F.col("key"))).alias("key")).distinct()
        above = family.filter(M.level(F.col("key")) > 0).select(F.explode(M.ancestors(M.parent(F.col("key")))).alias("key")).distinct()
        keys = family.union(above.select(F.explode(M.siblings(F.col("key"))).alias("key"))).distinct()
    else:
        shift = lambda lev: 3 * (MAX_DEPTH - lev) + M.LEVEL_BITS
        keys = spark.range(1).select(F.lit(0).cast("long").alias("key"))
        for lev in range(1, depth + 1):
            keys = keys.union(spark.range(8**lev).select(F.shiftleft("id", shift(lev)).bitwiseOR(F.lit(lev).cast("long")).alias("key")))
    made = keys.join(counts, "key", "left")
    return made.select("key", M.level(F.col("key")).alias("level"), M.parent(F.col("key")).alias("parent"), (M.level(F.col("key")) == depth).alias("is_leaf"), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def build(points: DataFrame, depth: int, prune: bool = True, domain: Domain | None = None, root: int | None = None) -> Tree:
    """A uniform tree. With ``root`` only the points under that box."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is 0 to {MAX_DEPTH}")
    points = schemas.points(points)
    domain = domain or domain_of(points)
    placed = keyed(points, domain, depth)
    if root is not None:
        if root & M.LEVEL_MASK > depth:
            raise ValueError("the root is below the tree's depth")
        placed = placed.filter(M.is_ancestor(F.lit(root).cast("long"), F.col("leaf_key")))
    counts = placed.groupBy(F.col("leaf_key").alias("key")).agg(F.count(F.lit(1)).alias("n_points"))
    return Tree(placed, boxes_of(counts.select("key"), depth, prune, counts), domain, depth)


def from_leaves(leaves: DataFrame, depth: int, points: DataFrame | None = None, domain: Domain | None = None) -> Tree:
    """A tree whose boxes follow from a set of leaves (key)."""
    none = leaves.select("key", F.lit(0).cast("long").alias("n_points")).distinct()
    return Tree(points, boxes_of(none.select("key"), depth, True, none), domain, depth)


def from_roots(points: DataFrame, roots: DataFrame, depth: int, domain: Domain) -> DataFrame:
    """root, leaf, n_points: the occupied leaves of the sub-tree under each root (key)."""
    placed = keyed(schemas.points(points), domain, depth)
    levels = [r[0] for r in roots.select(M.level(F.col("key"))).distinct().collect()]
    up = placed.select("leaf_key", F.explode(F.array(*[M.at_level(F.col("leaf_key"), lev) for lev in levels])).alias("root"))
    return up.join(roots.select(F.col("key").alias("root")), "root").groupBy("root", F.col("leaf_key").alias("leaf")).agg(F.count(F.lit(1)).alias("n_points"))


def partitioned(tree: Tree, sort: str = "samplesort", parts: int | None = None, global_depth: int = 1) -> Tree:
    """The tree with its points range-partitioned by key. ``simplesort`` deals them by the box of the global depth."""
    if sort not in SORTS:
        raise ValueError(f"sort is one of {SORTS}")
    n = parts or int(tree.points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = M.at_level(F.col("leaf_key"), global_depth) if sort == "simplesort" else None
    points = tree.points.repartition(n, by) if by is not None else tree.points.repartitionByRange(n, "leaf_key", "gid")
    return Tree(points.sortWithinPartitions("leaf_key", "gid"), tree.boxes, tree.domain, tree.depth)
