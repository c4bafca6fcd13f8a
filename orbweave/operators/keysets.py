"""Set operations on Morton keys: each takes and gives a frame with a column ``key``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import morton as M
from orbweave.operators.ranking import ranked
from orbweave.plans.storage import stored
from orbweave.schemas import MAX_DEPTH


def sort(keys: DataFrame) -> DataFrame:
    return keys.orderBy("key")


def add(keys: DataFrame, more: DataFrame) -> DataFrame:
    return keys.select("key").union(more.select("key"))


def linearize(keys: DataFrame) -> DataFrame:
    """The keys that aren't strictly above another one."""
    keys = keys.select("key").distinct()
    above = keys.filter(M.level(F.col("key")) > 0).select(F.explode(M.ancestors(M.parent(F.col("key")))).alias("key")).distinct()
    return keys.join(above, "key", "left_anti")


def balance(keys: DataFrame) -> DataFrame:
    """2:1 balance: level by level, the parents of a box's neighbours come in with their siblings; then linearised.

    What a level brings in depends on that level's boxes alone, so each round is one small stored table.
    """
    known = stored(keys.select("key").distinct(), "keys")
    deepest = known.agg(F.max(M.level(F.col("key")))).first()[0] or 0
    whole, added = known, None
    for lev in range(deepest, 1, -1):
        here = known.filter(M.level(F.col("key")) == lev)
        here = here if added is None else here.union(added)
        near = F.transform(F.array_union(M.neighbours(F.col("key")), F.array("key")), lambda k: M.at_level(k, lev - 2))
        added = stored(here.select(F.explode(F.array_distinct(near)).alias("key")).distinct().select(F.explode(M.children(F.col("key"))).alias("key")), "balanced")
        whole = whole.union(added)
    return linearize(whole)


def _children(key: int) -> list[int]:
    lev = key & M.LEVEL_MASK
    unit = 1 << (M.LEVEL_BITS + 3 * (MAX_DEPTH - lev - 1))
    return [key + 1 + i * unit for i in range(8)]


def _covers(a: int, b: int) -> bool:
    la, lb = a & M.LEVEL_MASK, b & M.LEVEL_MASK
    low = M.LEVEL_BITS + 3 * (MAX_DEPTH - la)
    return la <= lb and a >> low == b >> low


def _common(a: int, b: int) -> int:
    lev = min(a & M.LEVEL_MASK, b & M.LEVEL_MASK)
    while lev > 0 and (a ^ b) >> (M.LEVEL_BITS + 3 * (MAX_DEPTH - lev)):
        lev -= 1
    low = M.LEVEL_BITS + 3 * (MAX_DEPTH - lev)
    return ((a >> low) << low | lev) if lev else 0


def complete_region(a: int, b: int) -> list[int]:
    """The fewest boxes strictly between two keys, ascending (their number is bounded by the depth)."""
    a, b = min(a, b), max(a, b)
    out, work = [], _children(_common(a, b)) if a != b else []
    while work:
        key = work.pop()
        if a < key < b and not _covers(key, b) and not _covers(key, a):
            out.append(key)
        elif _covers(key, a) and key != a or _covers(key, b) and key != b:
            if key & M.LEVEL_MASK < MAX_DEPTH:
                work += _children(key)
    return sorted(x for x in out if not _covers(a, x) and not _covers(b, x))


def complete(keys: DataFrame) -> DataFrame:
    """The keys and the fewest boxes that fill the gaps between neighbours in key order.

    Neighbours meet by rank, so gaps are found without a single-task sort; only a gap's two ends reach the function
    that fills it, whose result is bounded by the depth.
    """
    order = ranked(keys.select("key").distinct(), ["key"], "rank")
    ends = order.join(order.select((F.col("rank") - 1).alias("rank"), F.col("key").alias("next")), "rank")

    @F.pandas_udf("array<long>")
    def fill(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([complete_region(int(x), int(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return order.select("key").union(ends.select(F.explode(fill("key", "next")).alias("key"))).distinct()


def complete_block_tree(seeds: DataFrame) -> DataFrame:
    """Seeds completed to the whole domain: the gaps at both ends are filled as well."""
    first, last = seeds.agg(F.min("key"), F.max("key")).first()
    deepest_first, deepest_last = MAX_DEPTH, (((1 << 48) - 1) << M.LEVEL_BITS) | MAX_DEPTH
    ends = [*_to_end(deepest_first, first), *_to_end(deepest_last, last)]
    return add(complete(seeds), seeds.sparkSession.createDataFrame([(k,) for k in ends], "key long") if ends else seeds.limit(0)).distinct()


def _to_end(end: int, seed: int) -> list[int]:
    """The boxes from a deepest end of the domain to a seed, the end's own largest box included."""
    if _covers(seed, end):
        return []
    top = _common(end, seed)
    mine = next(c for c in _children(top) if _covers(c, end))
    return [mine, *complete_region(mine, seed)]


def find_seeds(leaves: DataFrame) -> DataFrame:
    """The leaves of the coarsest level."""
    return leaves.join(F.broadcast(leaves.agg(F.min(M.level(F.col("key"))).alias("_lev"))), M.level(F.col("key")) == F.col("_lev")).select("key")


def assign(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (with base_key) and ``box``: the deepest of the boxes that holds each; points in none are dropped."""
    levels = [r[0] for r in boxes.select(M.level(F.col("key")).alias("l")).distinct().collect()]
    up = F.explode(F.array(*[M.at_level(F.col("base_key"), lev) for lev in sorted(levels)])) if levels else F.lit(None).cast("long")
    found = points.withColumn("box", up).join(boxes.select(F.col("key").alias("box")).distinct(), "box")
    keep = [c for c in points.columns]
    return found.groupBy(*keep).agg(F.max_by("box", M.level(F.col("box"))).alias("box"))


def empty_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    return boxes.select("key").join(assign(points, boxes).select(F.col("box").alias("key")).distinct(), "key", "left_anti")


def index_map(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """box, gids: the points of each box (a box's points are one row by definition)."""
    return assign(points, boxes).groupBy("box").agg(F.array_sort(F.collect_list("gid")).alias("gids"))


def split_blocks(points: DataFrame, boxes: DataFrame, n_crit: int) -> DataFrame:
    """Boxes refined until none has more than n_crit points (or the deepest level); points carry base_key."""
    done = None
    now = boxes.select("key").distinct()
    while True:
        counts = assign(points.select("gid", "base_key"), now).groupBy("box").agg(F.count(F.lit(1)).alias("n"))
        sized = now.join(counts.withColumnRenamed("box", "key"), "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).checkpoint()
        over = sized.filter((F.col("n") > n_crit) & (M.level(F.col("key")) < MAX_DEPTH))
        fine = sized.join(over.select("key"), "key", "left_anti").select("key")
        done = fine if done is None else done.union(fine)
        if over.isEmpty():
            return done
        now = over.select(F.explode(M.children(F.col("key"))).alias("key"))


def minimum_depth(n_points: int, n_crit: int) -> int:
    depth = 0
    while n_points > n_crit:
        depth += 1
        n_points //= 8
    return depth


def transfer_vectors(spark, lev: int = 3) -> DataFrame:
    """The 316 unique far-field offsets at a level: hash, dx, dy, dz, source, target (an example pair), by hash.

    A target among the 64 boxes around the domain's centre sees every offset whose parents touch.
    """
    unit = 1 << (MAX_DEPTH - lev)
    cells = spark.range(512).select(*[(F.shiftright(F.col("id"), 3 * i).bitwiseAND(7) * unit).alias(c) for i, c in enumerate("xyz")])
    if lev == 2:
        cells = cells.filter(f"x < {4 * unit} and y < {4 * unit} and z < {4 * unit}")
    keys = cells.select(M.encode(F.col("x"), F.col("y"), F.col("z"), lev).alias("key"))
    sources = F.explode(F.flatten(F.transform(F.array_union(M.neighbours(M.parent(F.col("key"))), F.array(M.parent(F.col("key")))), M.children)))
    pairs = keys.select(F.col("key").alias("target"), sources.alias("source")).filter(~M.touches(F.col("source"), F.col("target")))
    dx, dy, dz = M.transfer_components(F.col("source"), F.col("target"))
    named = pairs.select(dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), "source", "target").withColumn("hash", M.transfer_hash(F.col("dx"), F.col("dy"), F.col("dz")))
    return named.groupBy("hash", "dx", "dy", "dz").agg(F.min(F.struct("source", "target")).alias("e")).select("hash", "dx", "dy", "dz", "e.source", "e.target").orderBy("hash")
