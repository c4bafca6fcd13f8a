"""Fast sums over balanced adaptive trees: leaves on several levels, so that crowded regions have small leaves and empty ones none.

Both sets share one set of balanced leaves. Beside the passes of a uniform plan there are two more ways from sources to targets:

* P2L: what a leaf's points give a finer box that doesn't touch it, though its parent does (X list): potentials on the box's check surface.
* M2P: a finer box's multipoles at the points of a leaf that touches its parent only (W list).

Touching leaves are at most one level apart (U list), so every list is an equi-join on keys. A target leaf's block holds the leaves of its level
below the box two levels up, the source leaves that touch them and the multipoles of their W lists.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import kernels
from orbweave.functions import morton as M
from orbweave.operators import adaptive
from orbweave.operators import interactions as I
from orbweave.operators.domain import Domain, domain_of
from orbweave.operators.interactions import charge_matrix, result_batch
from orbweave.plans import engine
from orbweave.plans import translations as X
from orbweave.plans.storage import stored


class AdaptiveBuilder(engine.Builder):
    """tree(sources, targets, n_crit), parameters(...), build(): as the uniform builder's, with leaves where the points are."""

    def tree(self, sources: DataFrame, targets: DataFrame, n_crit: int = 150) -> AdaptiveBuilder:
        """A leaf holds at most ``n_crit`` points of both sets together (but for coincident ones at the deepest level)."""
        sources, targets = schemas.points(sources), schemas.points(targets)
        with ThreadPoolExecutor(2) as both:
            self.domain = Domain.union(*both.map(domain_of, (sources, targets)))
        self.source_tree, self.target_tree = adaptive.build(sources, targets, n_crit, self.domain)
        self.depth = self.source_tree.depth
        return self

    @property
    def plan_kind(self) -> type[engine.Fmm]:
        return AdaptiveFmm


@dataclass
class AdaptiveFmm(engine.Fmm):
    """A plan over a balanced adaptive tree; charges, access and results as of a uniform one."""

    #: The charges and what they give by P2L.
    _point_checks: tuple | None = None

    def target_top(self) -> dict[int, np.ndarray]:
        """None: points meet boxes of all levels, so that every level is a join."""
        return {}

    def target_leaves(self) -> DataFrame:
        return self.target_tree.boxes.filter("is_leaf").select("key")

    def source_leaves(self) -> DataFrame:
        return self.source_tree.boxes.filter("is_leaf").select("key")

    def u_list(self) -> DataFrame:
        """target, source: leaves that touch, stored once."""
        return self._once("u", lambda: stored(I.mixed_u_list(self.target_leaves(), self.source_leaves()), "u-list"))

    def w_list(self) -> DataFrame:
        """leaf (of targets), box (of sources), stored once."""
        return self._once("w", lambda: stored(I.w_list(self.target_leaves(), self.source_tree.boxes.select("key")), "w-list"))

    def x_list(self) -> DataFrame:
        """target (box), source (leaf), stored once."""
        return self._once("x", lambda: stored(I.x_list(self.target_boxes().select("key"), self.source_leaves()), "x-list"))

    def _checks(self, level: int, boxes: DataFrame | None, key: int | None = None) -> DataFrame | None:
        """P2L: the points of the X list's leaves at the check surfaces of a level's boxes (or of one). All boxes' are made at once."""
        if not self._once("x-levels", lambda: {r[0] for r in self.x_list().select(M.level(F.col("target"))).distinct().collect()}) & {level}:
            return None
        if key is not None:
            return self._from_points(self.x_list().filter(F.col("target") == key))
        if self._point_checks is None or self._point_checks[0] is not self.charges:
            self._point_checks = self.charges, self._from_points(self.x_list())
        return self._point_checks[1].filter(M.level(F.col("key")) == level)

    def _from_points(self, pairs: DataFrame) -> DataFrame:
        loaded = schemas.charged(self.source_tree.points, self.charges).withColumnRenamed("leaf_key", "source")
        rows = pairs.join(loaded, "source").select(F.col("target").alias("leaf_key"), "gid", "x", "y", "z", "vec_idx", "q", "q_im")
        return self._by_leaf("p2l", rows, engine._leaf_sums(self.operators.part(), lambda ops, *a: ops.p2l(*a), self.domain, self.vecs, self.clock))

    def crowded(self) -> tuple[DataFrame, int] | None:
        """block, parts of the blocks of leaves whose targets and touching sources are more than a task should hold, and the groups they make."""

        def look() -> tuple[DataFrame, int] | None:
            own = self.target_tree.boxes.filter("is_leaf").select(home("key").alias("block"), F.col("n_points").alias("n"), F.lit(0).alias("m"))
            near = self.u_list().select(home("target").alias("block"), "source").distinct()
            near = near.join(self.source_tree.boxes.select(F.col("key").alias("source"), F.col("n_points").alias("m")), "source").select("block", F.lit(0).alias("n"), "m")
            return I.shares(own.union(near).groupBy("block").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), self.near_points)

        return self._once(("crowded", self.near_points), look)

    def _near_leaves(self, leaf: int) -> list[int]:
        return [r[0] for r in self.u_list().filter(F.col("target") == leaf).select("source").collect()]

    def _leaf_rows(self, locals_: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
        own = engine._target_rows(targets, home("leaf_key"), self.element)
        here = own.select("block").distinct()
        near = self.u_list().select(home("target").alias("block"), F.col("source").alias("leaf_key")).distinct().join(here, "block", "left_semi")
        rows = own.union(engine._source_rows(sources.join(self.charges, "gid").join(near, "leaf_key"), F.col("block"), self.element))
        leaves = locals_.join(self.target_leaves(), "key", "left_semi").withColumn("block", home("key")).join(here, "block", "left_semi")
        rows = rows.union(engine._expansion_rows(leaves, F.col("block"), 2))
        far = self.w_list().select(home("leaf").alias("block"), F.col("box").alias("key")).distinct().join(here, "block", "left_semi")
        return rows.union(engine._expansion_rows(self._multipoles.join(far, "key"), F.col("block"), 4))

    def _leaf_work(self):
        return _leaf_blocks(self.operators, self.domain, self.vecs, self.gradient, self.clock)


def home(key: str):
    """The box two levels above a leaf; its level is part of it, so a block's leaves are on one level."""
    level = M.level(F.col(key))
    return F.when(level > engine.NEAR_BLOCK, M.at_level(F.col(key), level - engine.NEAR_BLOCK)).otherwise(-1 - level.cast("long"))


def spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower corners (n, 3) and edges of boxes in units of the deepest level."""
    level = keys & M.LEVEL_MASK
    return X.grid(keys, M.MAX_DEPTH), np.int64(1) << (M.MAX_DEPTH - level)


def touching(key: int, keys: np.ndarray) -> np.ndarray:
    """Which boxes meet a box (closed boxes)."""
    (at,), (edge,) = spans(np.array([key], np.int64))
    low, size = spans(keys)
    return ((low <= at + edge) & (at <= low + size[:, None])).all(1)


def above(keys: np.ndarray) -> np.ndarray:
    """Parents of boxes below the root."""
    low = M.LEVEL_BITS + 3 * (M.MAX_DEPTH - (keys & M.LEVEL_MASK) + 1)
    return keys >> low << low | ((keys & M.LEVEL_MASK) - 1)


def _leaf_blocks(ops: X.Operators, domain, vecs: list[int], gradient: bool, clock: engine.Clock):
    ops, width = ops.part(), 4 if gradient else 1

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        frame = table.filter(pa.array(kind < 2)).select(["kind", "key", "gid", "x", "y", "z", "vec_idx", "q", "q_im"]).to_pandas()
        by_leaf = {k: charge_matrix(p, vecs, ops.kernel.complex) for k, p in frame[frame.kind == 1].groupby("key")}
        leaves = np.array(sorted(by_leaf), np.int64)
        locals_, far = ({}, {})
        for k, found in ((2, locals_), (4, far)):
            for part in engine._runs_of_width(table.filter(pa.array(kind == k)).combine_chunks().to_batches()[0]) if (kind == k).any() else []:
                found |= dict(zip(*engine._values(part, len(vecs)), strict=True))
        boxes = np.array(sorted(far), np.int64)
        out = []
        for key, part in frame[frame.kind == 0].groupby("key"):
            level, xyz = key & M.LEVEL_MASK, part[["x", "y", "z"]].to_numpy(float)
            sums = np.zeros((width, len(part), len(vecs)), ops.result_dtype)
            near = leaves[touching(key, leaves)].tolist() if len(leaves) else []
            if near:
                with clock("p2p"):
                    e = kernels.evaluate(ops.kernel, xyz, *(np.concatenate(c) for c in zip(*(by_leaf[k] for k in near), strict=True)), gradient)
                sums += e if gradient else e[None]
            if key in locals_:
                with clock("l2p"):
                    sums += ops.l2p(xyz, locals_[key].T, X.centres(np.array([key]), level, domain.origin, domain.side)[0], level, gradient)
            mine = boxes[(boxes & M.LEVEL_MASK) == level + 1] if len(boxes) else boxes
            mine = mine[touching(key, above(mine)) & ~touching(key, mine)] if len(mine) else mine
            if len(mine):
                with clock("l2p"):
                    sums += ops.m2p(xyz, np.stack([far[k] for k in mine.tolist()]), X.centres(mine, level + 1, domain.origin, domain.side), level + 1, gradient)
            out.append(result_batch(part.gid.to_numpy(), vecs, sums, ops.kernel, gradient))
        empty = result_batch(np.empty(0, np.int64), vecs, np.zeros((width, 0, len(vecs)), ops.result_dtype), ops.kernel, gradient)
        return pa.Table.from_batches(out, schema=empty.schema)

    return run
