"""Fast summation over DataFrames: build a plan, evaluate it, attach new charges.

Points, boxes and expansions are tables. A plan holds two stored trees over one domain and the translation
operators. An evaluation runs

* P2M: sources range-partitioned by (leaf, gid), so a crowded leaf spreads over tasks; the leaves of a batch are expanded at once, and only
  the leaves at batches' borders are added up afterwards.
* M2M: three levels a stage. Boxes are dealt by the ancestor three levels up and sorted by key, so that each task streams whole sub-trees.
* M2L, L2L: levels with at most ``DRIVER_BOXES`` boxes are finished on the driver (the tree's top, of bounded size); deeper
  levels are joins: children to parents, and blocks of 8 x 8 x 8 boxes with the sources up to 3 boxes around them, so that a
  multipole is copied to the few blocks that need it rather than to up to 189 targets.
* P2P and L2P: blocks of 4 x 4 x 4 leaves with the source points of the leaves around, in numpy within each block.

Results are keyed by gid and vec_idx.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import kernels
from orbweave.functions import morton as M
from orbweave.operators import trees
from orbweave.operators.adaptive import boxes_above
from orbweave.operators.domain import Domain, domain_of
from orbweave.operators.interactions import NEAR_BLOCK, NEAR_POINTS, charge_matrix, direct, leaves_around, result_batch, shared, shares
from orbweave.operators.keysets import minimum_depth
from orbweave.operators.surfaces import box_surfaces
from orbweave.plans import translations as X
from orbweave.plans.storage import stored

#: Boxes of a level up to which the driver finishes it: the tree's first three levels.
DRIVER_BOXES = 64
#: Charged points of a task's share of the sources.
PART_POINTS = 2_000_000
#: Edge of a block, as levels above the boxes in it.
FAR_BLOCK = 3
#: Levels that one stage of the upward pass climbs.
LIFT = 3
EVAL_TYPES = ("Value", "ValueDeriv")
OPERATORS = ("p2m", "m2m", "m2l", "l2l", "l2p", "p2p")


class Clock:
    """Seconds of each operator, added up over tasks (a task that is run again counts again). Without a session nothing is timed."""

    def __init__(self, spark: SparkSession | None = None):
        self.seconds = {n: spark.sparkContext.accumulator(0.0) for n in OPERATORS} if spark else {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        started = time.perf_counter()
        yield
        if self.seconds:
            self.seconds[name].add(time.perf_counter() - started)

    def read(self) -> dict[str, float]:
        return {n: float(a.value) for n, a in self.seconds.items()}


class Builder:
    """tree(...), parameters(...), build()."""

    def __init__(self, spark: SparkSession, timed: bool = False):
        self.spark, self.timed = spark, timed
        self.times: dict[str, float] = {}

    def tree(self, sources: DataFrame, targets: DataFrame, n_crit: int | None = None, depth: int | None = None, prune_empty: bool = True, global_depth: int | None = None, local_depth: int | None = None, sort: str | None = None) -> Builder:
        """Both trees over one domain. Exactly one of n_crit and depth; global_depth and local_depth together stand for their
        sum. ``sort`` lays the stored points out by key (samplesort, hyksort) or by box of the global depth (simplesort).
        """
        if (global_depth is None) != (local_depth is None):
            raise ValueError("give both global_depth and local_depth, or neither")
        if global_depth is not None and depth is None:
            depth = global_depth + local_depth
        if (n_crit is None) == (depth is None):
            raise ValueError("give exactly one of n_crit and depth")
        started = time.perf_counter()
        sources, targets = schemas.points(sources), schemas.points(targets)
        with ThreadPoolExecutor(2) as both:  # the jobs of the two sets run side by side
            self.domain = Domain.union(*both.map(domain_of, (sources, targets)))
        if depth is None:
            depth = max(minimum_depth(sources.count(), n_crit), minimum_depth(targets.count(), n_crit))
        self.depth = depth
        with ThreadPoolExecutor(2) as both:
            self.source_tree, self.target_tree = both.map(lambda p, name: self._kept(trees.build(p, depth, prune_empty, self.domain), prune_empty, name), (sources, targets), ("source", "target"))
        if sort is not None:
            self.source_tree, self.target_tree = (replace(t, points=stored(trees.partitioned(t, sort, global_depth=global_depth or 1).points, "sorted")) for t in (self.source_tree, self.target_tree))
        self.times["tree"] = time.perf_counter() - started
        return self

    def _kept(self, tree: trees.Tree, prune: bool, name: str) -> trees.Tree:
        """The tree with its points and boxes stored, boxes from the stored keys; ids are checked meanwhile."""
        points = stored(tree.points, f"{name}-points")
        counts = points.groupBy(F.col("leaf_key").alias("key")).agg(F.count(F.lit(1)).alias("n_points"))
        with ThreadPoolExecutor(1) as beside:
            checked = beside.submit(schemas.unique, points, f"{name} points")
            boxes = stored(trees.boxes_of(counts.select("key"), tree.depth, prune, counts), f"{name}-boxes")
            return replace(tree, points=checked.result(), boxes=boxes)

    def parameters(self, charges: DataFrame, orders: list[int] | int, kernel, eval_type: str = "Value", m2l=None, pinv: X.Pinv | None = None, precision: str = "double") -> Builder:
        """``precision`` single holds and shuffles expansions in 32 bits: for three or four digits, at half the bytes."""
        if precision not in ("single", "double"):
            raise ValueError("precision is single or double")
        if eval_type not in EVAL_TYPES:
            raise ValueError(f"eval_type is one of {EVAL_TYPES}")
        self.kernel, self.gradient = kernel, eval_type == "ValueDeriv"
        m2l = m2l or X.Fft()
        self.operators = X.Operators(kernel, self.domain.side, self.depth, [orders] if isinstance(orders, int) else list(orders), m2l, pinv or X.Pinv(), precision == "single")
        self.charges = schemas.charges(charges)
        self.vecs = vectors(self.charges)
        if len(self.vecs) > 1 and not m2l.many_vectors:
            raise ValueError("several right-hand sides need a low-rank or dense far field")
        return self

    @property
    def plan_kind(self) -> type[Fmm]:
        return Fmm

    def build(self) -> Fmm:
        """Makes the operators of all levels and the plan; what its passes ask of the trees is looked up meanwhile."""
        started = time.perf_counter()
        plan = self.plan_kind(self.spark, self.source_tree, self.target_tree, self.operators, self.charges, self.vecs, self.gradient, self.timed, dict(self.times), clock=Clock(self.spark if self.timed else None))
        with ThreadPoolExecutor(3) as beside:
            asked = [beside.submit(ask) for ask in (plan.source_levels, plan.target_top, plan.crowded)]
            self._make()
            for a in asked:
                a.result()
        plan.times["operators"] = self.times["operators"] = time.perf_counter() - started
        return plan

    def _make(self) -> None:
        pieces = self._pieces()
        for level in range(self.depth, -1, -1):
            self.operators.inverse(level, True)
        for level in self.operators.far_levels():
            self.operators.far(level, pieces.get(level))

    def _pieces(self) -> dict[int, dict]:
        """Far-field pieces by level and offset where each is compressed by itself: a row of a Spark job for each."""
        ops, levels = self.operators, self.operators.far_levels()
        if ops.far_kind is not X.PairField or not levels:
            return {}

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [pickle.dumps(ops.far_kind.piece(ops, level, X.OFFSETS[i])) for level, i in zip(*map(pa.Array.to_pylist, batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["level", "offset", "piece"])

        wanted = self.spark.createDataFrame([(level, i) for level in levels for i in range(len(X.OFFSETS))], "level int, offset int")
        found = wanted.repartition(self.spark.sparkContext.defaultParallelism).mapInArrow(make, "level int, offset int, piece binary").collect()
        return {level: {X.OFFSETS[x.offset]: pickle.loads(x.piece) for x in sorted(found) if x.level == level} for level in levels}


def vectors(charges: DataFrame) -> list[int]:
    found = sorted(r[0] for r in charges.select("vec_idx").distinct().collect())
    if not found:
        raise ValueError("no charges")
    return found


@dataclass
class Fmm:
    """A plan that can be evaluated again with other charges."""

    spark: SparkSession
    source_tree: trees.Tree
    target_tree: trees.Tree
    operators: X.Operators
    charges: DataFrame
    vecs: list[int]
    gradient: bool
    timed: bool = False
    times: dict = field(default_factory=dict)
    driver_boxes: int = DRIVER_BOXES
    near_points: int = NEAR_POINTS
    clock: Clock = field(default_factory=Clock)
    found: dict = field(default_factory=dict)
    touched: tuple[int, int] | None = None
    _multipoles: DataFrame | None = None
    _locals: DataFrame | None = None
    _results: DataFrame | None = None

    # ---- properties
    @property
    def kernel(self):
        return self.operators.kernel

    @property
    def depth(self) -> int:
        return self.operators.depth

    @property
    def domain(self):
        return self.source_tree.domain

    @property
    def dim(self) -> int:
        return 3

    @property
    def variable_expansion_order(self) -> bool:
        return len(self.operators.orders) > 1

    def equivalent_surface_order(self, level: int) -> int:
        return self.operators.order(level)

    def check_surface_order(self, level: int) -> int:
        return self.operators.check_order(level)

    def n_coeffs(self, level: int) -> int:
        return self.operators.n_coeffs(level)

    # ---- charges
    def clear(self) -> None:
        """Forgets expansions and results of earlier charges."""
        self._multipoles = self._locals = self._results = None

    def attach_charges_unordered(self, charges: DataFrame) -> Fmm:
        """The plan with new charges by gid; as many right-hand sides as before."""
        charges = schemas.charges(charges)
        vecs = vectors(charges)
        if len(vecs) != len(self.vecs):
            raise ValueError("a plan keeps its number of right-hand sides")
        return replace(self, charges=charges, vecs=vecs, _multipoles=None, _locals=None, _results=None, times=dict(self.times))

    def change_charges(self, changes: DataFrame) -> Fmm:
        """The plan with some charges changed: ``changes`` holds new values by gid (and vec_idx); all others stay.

        Sums are linear. Only the changed sources' leaves and the boxes above them go up, only boxes that see these get far fields, and
        what they give is added to the expansions and results so far, which are evaluated first if they aren't. ``touched`` of the new plan
        tells how many source boxes took part, of how many.
        """
        self.evaluate()
        amounts = [F.sum(c).alias(c) for c in ("q", "q_im")]
        new = schemas.charges(changes).groupBy("gid", "vec_idx").agg(*amounts)
        if not set(vectors(new)) <= set(self.vecs):
            raise ValueError("a plan keeps its right-hand sides")
        old = self.charges.groupBy("gid", "vec_idx").agg(*amounts)
        both = old.withColumnsRenamed({"q": "was", "q_im": "was_im"}).join(new, ["gid", "vec_idx"], "full")
        both = stored(both.join(self.source_tree.points.select("gid"), "gid", "left_semi"), "charges")
        after = both.select("gid", "vec_idx", F.coalesce("q", "was").alias("q"), F.when(F.col("q").isNotNull(), F.col("q_im")).otherwise(F.col("was_im")).alias("q_im"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        differ = both.filter("q is not null").select("gid", "vec_idx", (F.col("q") - zero("was")).alias("q"), (F.col("q_im") - zero("was_im")).alias("q_im"))
        differ = stored(differ.filter("q != 0 or q_im != 0"), "changes")
        points = stored(self.source_tree.points.join(differ.select("gid").distinct(), "gid", "left_semi"), "changed-points")
        counts = points.groupBy(F.col("leaf_key").alias("key")).agg(F.count(F.lit(1)).alias("n_points"))
        boxes = stored(boxes_above(counts), "changed-boxes")
        tree = replace(self.source_tree, points=points, boxes=boxes)
        kept = {k: v for k, v in self.found.items() if k == "targets"}
        part = replace(self, source_tree=tree, charges=differ, found=kept, _multipoles=None, _locals=None, _results=None, times={})
        whole = replace(self, charges=after, times=dict(self.times), touched=(boxes.count(), self.source_tree.boxes.filter("n_points > 0 or not is_leaf").count()))
        if not points.isEmpty():
            names = kernels.result_columns(self.kernel, self.gradient)
            whole._results = stored(self._results.union(part.evaluate().select(self._results.columns)).groupBy("gid", "vec_idx").agg(*[F.sum(n).alias(n) for n in names]), "leaf-targets")
            whole._multipoles, whole._locals = self._both(self._multipoles, part._multipoles), self._both(self._locals, part._locals)
        return whole

    def _both(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Expansions of two sums added, stored."""
        columns = ["key", "coeff", "coeff_im"]
        made = _added(one.select(columns).union(other.select(columns)), len(self.vecs))
        return stored(made.select("key", M.level(F.col("key")).alias("level"), "coeff", "coeff_im"), "expansions")

    def attach_charges_ordered(self, charges: DataFrame) -> Fmm:
        """New charges by rank in tree order (column rank from 1) instead of gid."""
        ranks = self.source_tree.global_indices()
        return self.attach_charges_unordered(charges.join(ranks, "rank"))

    # ---- what the passes ask of the trees: looked up once, whatever the charges
    def _once(self, name, look):
        if name not in self.found:
            self.found[name] = look()
        return self.found[name]

    def source_levels(self) -> dict[int, tuple[int, int]]:
        """Boxes, and points in leaves, of each level of the source tree."""
        boxes = self.source_tree.boxes.filter("n_points > 0 or not is_leaf").groupBy("level")
        return self._once("sources", lambda: {r["level"]: (r["n"], r["points"]) for r in boxes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_points").alias("points")).collect()})

    def target_boxes(self) -> DataFrame:
        """Boxes with target points below them: key, level."""
        occupied = self.target_tree.boxes.filter("is_leaf and n_points > 0").select("key")
        up = F.explode(M.ancestors(F.col("key"))) if self.depth else F.col("key")
        return self._once("targets", lambda: stored(occupied.select(up.alias("key")).distinct().select("key", M.level(F.col("key")).alias("level")), "target-occupied"))

    def target_top(self) -> dict[int, np.ndarray]:
        """Sorted target boxes of the levels from 2 down that the driver finishes: all with at most ``driver_boxes`` boxes in both trees."""

        def look() -> dict[int, np.ndarray]:
            sources, top = self.source_levels(), 1
            counts = {r["level"]: r["n"] for r in self.target_boxes().groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
            while top < self.depth and max(counts.get(top + 1, 0), sources.get(top + 1, (0, 0))[0]) <= self.driver_boxes:
                top += 1
            known = self.target_boxes().filter(F.col("level").between(2, top)).collect() if top > 1 else []
            return {level: np.sort(np.array([r["key"] for r in known if r["level"] == level], np.int64)) for level in range(2, top + 1)}

        return self._once(("top", self.driver_boxes), look)

    def crowded(self) -> tuple[DataFrame, int] | None:
        """block, parts of the blocks of leaves with more points or pairs than a task should hold, and the groups they make; None if there are
        none. From leaf counts alone; pairs are those of a block's targets with all sources in and around it."""

        def look() -> tuple[DataFrame, int] | None:
            block = max(self.depth - NEAR_BLOCK, 0)
            full = lambda tree: tree.boxes.filter("is_leaf and n_points > 0")
            own = full(self.target_tree).select(M.at_level(F.col("key"), block).alias("block"), F.col("n_points").alias("n"), F.lit(0).alias("m"))
            near = full(self.source_tree).select(F.explode(M.blocks_around(F.col("key"), 1, block)).alias("block"), F.lit(0).alias("n"), F.col("n_points").alias("m"))
            return shares(own.union(near).groupBy("block").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), self.near_points)

        return self._once(("crowded", self.near_points), look)

    # ---- passes
    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        started = time.perf_counter()
        df = stored(df, name)
        self.times[name] = time.perf_counter() - started
        return df

    def _pass(self, name: str, run, df: DataFrame) -> DataFrame:
        """A pass whose levels are stored one by one, or rows of the tree's top."""
        started = time.perf_counter()
        df = run(df)
        self.times[name] = time.perf_counter() - started
        return df

    @property
    def element(self) -> str:
        """Spark's type of an expansion's numbers."""
        return "float" if self.operators.single else "double"

    def _expansions(self) -> str:
        return f"key long, coeff array<{self.element}>, coeff_im array<{self.element}>"

    def leaf_sources(self) -> DataFrame:
        """P2M, stored: key, coeff, coeff_im of each source leaf (right-hand sides one after the other). A source without a charge is an error."""
        loaded = schemas.charged(self.source_tree.points, self.charges).select("leaf_key", "gid", "x", "y", "z", "vec_idx", "q", "q_im")
        return self._by_leaf("p2m", loaded, _p2m(self.operators, self.domain, self.vecs, self.leaf_levels(), self.clock))

    def _by_leaf(self, name: str, rows: DataFrame, work) -> DataFrame:
        """Sums over rows leaf_key, gid, ... by leaf. Rows are range-partitioned by (leaf, gid); ``work`` gives a row for each leaf of a
        batch and marks those at its borders, which alone are added up."""
        n = sum(points for _, points in self.source_levels().values()) * len(self.vecs)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_POINTS))
        placed = rows.repartitionByRange(parts, "leaf_key", "gid").sortWithinPartitions("leaf_key", "gid")
        made = self._stage(name, placed.mapInArrow(work, self._expansions() + ", border boolean"))
        columns = ["key", "coeff", "coeff_im"]
        return made.filter("not border").select(*columns).union(_added(made.filter("border").select(*columns), len(self.vecs)))

    def leaf_levels(self) -> list[int]:
        """Levels that source leaves are on."""
        return [level for level, (_, points) in self.source_levels().items() if points] or [self.depth]

    def upward(self, leaves: DataFrame) -> DataFrame:
        """M2M: key, level, coeff, coeff_im of all boxes of level 1 and deeper (level 0 as well). Leaves may be on several levels."""
        ops, n_vecs = self.operators, len(self.vecs)
        counts = self.source_levels()
        leaves = leaves.select("key", M.level(F.col("key")).alias("level"), "coeff", "coeff_im")
        now, found, level = leaves.filter(F.col("level") == self.depth), [leaves], self.depth
        top = self.depth
        while top > 0 and counts.get(top, (0, 0))[0] > self.driver_boxes:
            top -= 1
        while level > top:
            to = max(top, level - LIFT)
            mine = now if level == self.depth else now.union(leaves.filter(F.col("level") == level))
            rows = mine.union(leaves.filter(F.col("level").between(to + 1, level - 1)))
            rows = rows.withColumn("above", M.at_level(F.col("key"), to)).repartition("above").sortWithinPartitions("above", "key")
            made = self._stage(f"m2m-{level}", rows.mapInArrow(_m2m(ops, level, to, n_vecs, self.clock), f"level int, {self._expansions()}"))
            found.append(made.select("key", "level", "coeff", "coeff_im"))
            now, level = found[-1].filter(F.col("level") == to), to
        if level > 0:
            more = leaves.filter(F.col("level") < level) if level == self.depth else leaves.filter(F.col("level") <= level)
            known = now.union(more).toArrow()
            by_level = {lev: _sorted(known.filter(pa.array(known.column("level").to_numpy() == lev)), n_vecs, ops.dtype) for lev in set(known.column("level").to_pylist())}
            rows = []
            with self.clock("m2m"):
                for lev, keys, values in _climbed(ops, by_level, level, 0):
                    rows += _rows(keys, values, lev)
            found.append(_frame(self.spark, rows, self.element))
        whole = found[0]
        for more in found[1:]:
            whole = whole.union(more)
        return whole

    def downward(self, multipoles: DataFrame) -> DataFrame:
        """M2L and L2L: key, level, coeff, coeff_im of target boxes of level 2 and deeper."""
        ops, n_vecs = self.operators, len(self.vecs)
        boxes, known = self.target_boxes(), self.target_top()
        top = max(known, default=1)
        above_keys, above = np.empty(0, np.int64), np.zeros((0, n_vecs, ops.n_coeffs(min(2, self.depth))), ops.dtype)
        rows = []
        for level, keys in known.items():
            s_keys, s_values = _gathered(multipoles.filter(F.col("level") == level).select("key", "coeff", "coeff_im"), n_vecs, ops.dtype)
            local = np.zeros((len(keys), n_vecs, ops.n_coeffs(level)), ops.dtype)
            if len(s_keys):
                with self.clock("m2l"):
                    local += ops.check_to_local(level, ops.far(level).apply(s_values, s_keys, keys, level))
            if level > 2:
                with self.clock("l2l"):
                    local += X.down(ops, keys, level, above_keys, above)
            above_keys, above = keys, local
            rows += _rows(keys, local, level)
        found = [_frame(self.spark, rows, self.element)]
        before = found[0].filter(F.col("level") == top).select("key", "coeff", "coeff_im")
        for level in range(max(2, top + 1), self.depth + 1):
            here = boxes.filter(F.col("level") == level).select("key")
            theirs = multipoles.filter(F.col("level") == level).select("key", "coeff", "coeff_im")
            before = self._stage(f"down-{level}", self._level_down(level, here, theirs, before))
            found.append(_at(before, level))
        whole = found[0]
        for more in found[1:]:
            whole = whole.union(more)
        return whole

    def _checks(self, level: int, boxes: DataFrame | None, key: int | None = None) -> DataFrame | None:
        """key, coeff, coeff_im: potentials on check surfaces of a level's target boxes (or of one) that don't come from multipoles. None in a uniform tree."""
        return None

    def _level_down(self, level: int, boxes: DataFrame, multipoles: DataFrame, above: DataFrame) -> DataFrame:
        """One deep level: blocks of targets meet the multipoles around them, their parents' locals and potentials of points."""
        block = max(level - FAR_BLOCK, 0)
        home = lambda c: M.at_level(F.col(c), block)
        nil = [F.lit(None).cast(f"array<{self.element}>").alias(c) for c in ("coeff", "coeff_im")]
        own = boxes.select(home("key").alias("block"), F.lit(0).alias("kind"), "key", *nil)
        sources = multipoles.select(F.explode(M.blocks_around(F.col("key"), 3, block)).alias("block"), F.lit(1).alias("kind"), "key", "coeff", "coeff_im")
        parents = above.join(boxes.select(M.parent(F.col("key")).alias("key")).distinct(), "key", "left_semi")
        parents = parents.select(home("key").alias("block"), F.lit(2).alias("kind"), "key", "coeff", "coeff_im") if level > 2 else None
        sources = sources.join(own.select("block").distinct(), "block", "left_semi")
        rows = own.union(sources) if parents is None else own.union(sources).union(parents)
        checks = self._checks(level, boxes)
        if checks is not None:
            rows = rows.union(checks.select(home("key").alias("block"), F.lit(3).alias("kind"), "key", "coeff", "coeff_im"))
        return rows.groupBy("block").applyInArrow(_blocks_down(self.operators, level, len(self.vecs), self.clock), self._expansions())

    def leaf_targets(self, locals_: DataFrame) -> DataFrame:
        """P2P and L2P: gid, vec_idx and the result columns."""
        return self._leaf_pass(self._leaf_rows(locals_, self.target_tree.points, self.source_tree.points), self.crowded())

    def _leaf_rows(self, locals_: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
        """Blocks of target leaves with the sources of the leaves around them and their own local expansions."""
        block = max(self.depth - NEAR_BLOCK, 0)
        own = _target_rows(targets, M.at_level(F.col("leaf_key"), block), self.element)
        loaded = sources.join(self.charges, "gid").withColumn("block", F.explode(M.blocks_around(F.col("leaf_key"), 1, block)))
        rows = own.union(_source_rows(loaded.join(own.select("block").distinct(), "block", "left_semi"), F.col("block"), self.element))
        if self.depth >= 2:
            leaves = locals_.filter(F.col("level") == self.depth)
            rows = rows.union(_expansion_rows(leaves, M.at_level(F.col("key"), block), 2))
        return rows

    def _leaf_work(self):
        return _leaf_blocks(self.operators, self.domain, self.vecs, self.gradient, self.clock)

    def _leaf_pass(self, rows: DataFrame, crowded: tuple[DataFrame, int] | None) -> DataFrame:
        names = kernels.result_columns(self.kernel, self.gradient)
        schema = "gid long, vec_idx int, " + ", ".join(f"{n} double" for n in names)
        return shared(rows, crowded, self._leaf_work(), schema, names)

    def evaluate(self) -> DataFrame:
        """gid, vec_idx and the result columns for every target, stored."""
        if self._locals is None:
            self._expand()
            self._locals = self._pass("downward", self.downward, self._multipoles) if self.depth >= 2 else self._multipoles.limit(0)
        if self._results is None:
            self._results = self._stage("leaf-targets", self.leaf_targets(self._locals))
        return self._results

    def _expand(self) -> None:
        if self._multipoles is None:
            self._multipoles = self._pass("upward", self.upward, self.leaf_sources())

    # ---- access
    def multipoles(self, level: int | None = None) -> DataFrame:
        """key, level, vec_idx, coeff, coeff_im."""
        self._expand()
        return self._by_vector(self._multipoles, level)

    def multipole(self, key: int) -> DataFrame:
        return self.multipoles().filter(F.col("key") == key)

    def locals(self, level: int | None = None) -> DataFrame:
        if self._locals is None:
            self.multipoles()
            self._locals = self._pass("downward", self.downward, self._multipoles)
        return self._by_vector(self._locals, level)

    def local(self, key: int) -> DataFrame:
        """The local expansion of a box. Unless all are there already, only those of the boxes above it are made: each from the at most 189 boxes
        of its far list."""
        if self._locals is None and key & M.LEVEL_MASK >= 2:
            return self._by_vector(self._local(key), None)
        return self.locals().filter(F.col("key") == key)

    def _local(self, key: int) -> DataFrame:
        """key, level, coeff, coeff_im of one box, from the multipoles that it and the boxes above it see."""
        self._expand()
        ops, n_vecs, cone = self.operators, len(self.vecs), X.seen(key)
        found = self._multipoles.filter(F.col("key").isin([int(k) for keys in cone.values() for k in keys])).toArrow()
        levels = found.column("level").to_numpy()
        above_keys, above = np.empty(0, np.int64), np.zeros((0, n_vecs, 1), ops.dtype)
        path = {k & M.LEVEL_MASK: k for k in _path(key)}
        for level in cone:
            mine = np.array([path[level]], np.int64)
            local = np.zeros((1, n_vecs, ops.n_coeffs(level)), ops.dtype)
            keys, values = _sorted(found.filter(pa.array(levels == level)), n_vecs, ops.dtype)
            if len(keys):
                local += ops.check_to_local(level, ops.far(level).apply(values, keys, mine, level))
            checks = self._checks(level, None, path[level])
            if checks is not None:
                for part in checks.toArrow().combine_chunks().to_batches():
                    local += ops.check_to_local(level, _values(part, n_vecs)[1].sum(0, keepdims=True))
            if len(above_keys):
                local += X.down(ops, mine, level, above_keys, above)
            above_keys, above = mine, local
        return _frame(self.spark, _rows(above_keys, above, key & M.LEVEL_MASK), self.element)

    def _by_vector(self, df: DataFrame, level: int | None) -> DataFrame:
        df = df if level is None else df.filter(F.col("level") == level)
        n = (F.size("coeff") / len(self.vecs)).cast("int")
        made = df.select("key", "level", F.explode(F.sequence(F.lit(0), F.lit(len(self.vecs) - 1))).alias("i"), "coeff", "coeff_im").withColumn("n", n)
        cut = lambda c: F.slice(c, F.col("i") * F.col("n") + 1, F.col("n")).alias(c)
        return made.select("key", "level", F.element_at(F.array(*map(F.lit, self.vecs)), F.col("i") + 1).alias("vec_idx"), cut("coeff"), cut("coeff_im"))

    def surface(self, keys: DataFrame, alpha: float, order: int) -> DataFrame:
        """key, point, x, y, z: surfaces of boxes (column key) of this plan's domain."""
        return box_surfaces(keys, self.domain, order, alpha)

    def evaluate_kernel(self, sources: DataFrame, targets: DataFrame, charges: DataFrame, gradient: bool | None = None) -> DataFrame:
        """The exact sums of this plan's kernel over any points."""
        return direct(targets, sources, schemas.charges(charges), self.kernel, self.gradient if gradient is None else gradient)

    def operator_times(self) -> dict[str, float]:
        """Seconds of the passes run so far; of a timed plan those of each operator too, added up over tasks."""
        passes = {f"{k}-pass" if k in OPERATORS else k: v for k, v in self.times.items() if k not in ("tree", "operators")}
        return passes | self.clock.read()

    def metadata_times(self) -> dict[str, float]:
        """Seconds of building the trees and the translation operators."""
        return {k: v for k, v in self.times.items() if k in ("tree", "operators")}

    def potentials(self) -> DataFrame:
        return self.evaluate()

    def potential(self, leaf: int) -> DataFrame:
        """Results of a leaf's targets, in tree order. Unless all are there already, only the leaf's local expansion and its near leaves are read."""
        targets = self.target_tree.leaf_points(leaf)
        if self._results is not None:
            return self._results.join(targets.select("gid"), "gid").orderBy("gid", "vec_idx")
        self._expand()
        locals_ = self._locals if self._locals is not None else self._local(leaf) if leaf & M.LEVEL_MASK >= 2 else self._multipoles.limit(0)
        sources = self.source_tree.points.filter(F.col("leaf_key").isin(self._near_leaves(leaf)))
        return self._leaf_pass(self._leaf_rows(locals_, targets, sources), self.crowded()).orderBy("gid", "vec_idx")

    def _near_leaves(self, leaf: int) -> list[int]:
        """The leaves whose points meet a leaf's directly."""
        return leaves_around(leaf).tolist()

    def potentials_in_tree_order(self) -> DataFrame:
        return self.evaluate().join(self.target_tree.global_indices(), "gid").orderBy("rank", "vec_idx")


# ---- rows of leaf blocks: targets (kind 0), sources (1), locals (2), multipoles (4) ----------------------------------------


def _nothing(*names: str, element: str = "double") -> list:
    kinds = {"gid": "long", "vec_idx": "int", "coeff": f"array<{element}>", "coeff_im": f"array<{element}>"}
    return [F.lit(None if c.startswith("coeff") else 0).cast(kinds.get(c, "double")).alias(c) for c in names]


def _target_rows(points: DataFrame, block, element: str) -> DataFrame:
    return points.select(block.alias("block"), F.lit(0).alias("kind"), F.col("leaf_key").alias("key"), "gid", "x", "y", "z", *_nothing("vec_idx", "q", "q_im", "coeff", "coeff_im", element=element))


def _source_rows(loaded: DataFrame, block, element: str) -> DataFrame:
    return loaded.select(block.alias("block"), F.lit(1).alias("kind"), F.col("leaf_key").alias("key"), "gid", "x", "y", "z", "vec_idx", "q", "q_im", *_nothing("coeff", "coeff_im", element=element))


def _expansion_rows(expansions: DataFrame, block, kind: int) -> DataFrame:
    return expansions.select(block.alias("block"), F.lit(kind).alias("kind"), "key", *_nothing("gid", "x", "y", "z", "vec_idx", "q", "q_im"), "coeff", "coeff_im")


# ---- expansions as rows --------------------------------------------------------------------------------------------------


def _rows(keys: np.ndarray, values: np.ndarray, level: int) -> list[tuple]:
    flat = values.reshape(len(keys), int(np.prod(values.shape[1:])))
    im = [None] * len(keys) if not np.iscomplexobj(flat) else flat.imag.tolist()
    return [(int(k), level, v, w) for k, v, w in zip(keys, flat.real.tolist(), im, strict=True)]


def _path(key: int) -> list[int]:
    """A box and those above it."""
    out = [key]
    while out[-1] & M.LEVEL_MASK:
        out.append(int(X.parents(np.array([out[-1]], np.int64), out[-1] & M.LEVEL_MASK)[0][0]))
    return out


def _frame(spark: SparkSession, rows: list[tuple], element: str) -> DataFrame:
    return spark.createDataFrame(rows, f"key long, level int, coeff array<{element}>, coeff_im array<{element}>")


def _at(df: DataFrame, level: int) -> DataFrame:
    return df.select("key", F.lit(level).alias("level"), "coeff", "coeff_im")


def _values(batch: pa.RecordBatch | pa.Table, n_vecs: int) -> tuple[np.ndarray, np.ndarray]:
    """keys and (n, vecs, coefficients) of rows key, coeff, coeff_im."""
    n = len(batch)
    keys = batch.column("key").to_numpy() if isinstance(batch, pa.Table) else np.asarray(batch.column(batch.schema.get_field_index("key")))
    col = lambda c: batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(c))
    re = col("coeff").flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, n_vecs))
    im = col("coeff_im").flatten().to_numpy()
    values = re + 1j * im.reshape(n, -1) if len(im) else re
    return keys, values.reshape(n, n_vecs, -1)


def _gathered(df: DataFrame, n_vecs: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows key, coeff, coeff_im of a level of bounded size, sorted by key."""
    return _sorted(df.toArrow(), n_vecs, dtype)


def _sorted(rows: pa.RecordBatch | pa.Table, n_vecs: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    keys, values = _values(rows, n_vecs)
    order = np.argsort(keys)
    return keys[order], values[order].astype(dtype)


def _batch(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    flat = values.reshape(len(keys), int(np.prod(values.shape[1:])))
    width = flat.shape[1]
    at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width)
    lists = lambda x: pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).reshape(-1)))
    im = lists(flat.imag) if np.iscomplexobj(flat) else pa.nulls(len(keys), pa.list_(pa.from_numpy_dtype(flat.dtype)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists(flat.real), im], names=["key", "coeff", "coeff_im"])


def _added(partials: DataFrame, n_vecs: int) -> DataFrame:
    """Partial expansions added by key: dealt and sorted by key, summed by runs of rows; the last key of a batch waits for the next."""

    def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[begins], np.add.reduceat(values, begins, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in _runs_of_width(batch):
                keys, values = sums(*_values(part, n_vecs))
                if held is not None and held[0][0] == keys[0]:
                    values[0] += held[1][0]
                elif held is not None:
                    yield _batch(*held)
                if len(keys) > 1:
                    yield _batch(keys[:-1], values[:-1])
                held = keys[-1:], values[-1:]
        if held is not None:
            yield _batch(*held)

    return partials.repartition("key").sortWithinPartitions("key").mapInArrow(run, partials.schema)


def _runs_of_width(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows whose expansions are of one length (boxes of different levels may differ in it)."""
    if len(batch):
        width = batch.column(batch.schema.get_field_index("coeff")).value_lengths().to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(width[1:] != width[:-1]) + 1, len(batch)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def _leaf_groups(batch: pa.RecordBatch, vecs: list[int], complex_: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows leaf_key, gid, x, y, z, vec_idx, q, q_im sorted by (leaf, gid): leaves, where each one's points begin, points and charges."""
    key, gid, x, y, z, vec, q, q_im = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (gid[1:] != gid[:-1])])
    charges = np.zeros((len(first), len(vecs)), complex if complex_ else float)
    np.add.at(charges, (np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)])), np.searchsorted(vecs, vec)), q + 1j * q_im if complex_ else q)
    mine = key[first]
    begins = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
    return mine[begins], begins, np.stack([x[first], y[first], z[first]], 1), charges


def _p2m(ops: X.Operators, domain, vecs: list[int], levels: list[int], clock: Clock):
    for level in levels:
        ops.inverse(level, True)
    return _leaf_sums(ops.part("inverse"), lambda ops, *a: ops.p2m(*a), domain, vecs, clock)


def _leaf_sums(ops: X.Operators, expand, domain, vecs: list[int], clock: Clock):
    """Expansions of the leaves of each batch of points, a level at a time; the first and the last leaf of a batch are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys, begins, xyz, q = _leaf_groups(batch, vecs, ops.kernel.complex)
            level, sizes = keys & M.LEVEL_MASK, np.diff(np.r_[begins, len(xyz)])
            for lev in np.unique(level).tolist():
                mine = np.flatnonzero(level == lev)
                rows = slice(None) if len(mine) == len(keys) else np.repeat(level == lev, sizes)
                with clock("p2m"):
                    values = expand(ops, xyz[rows], q[rows], X.centres(keys[mine], lev, domain.origin, domain.side), sizes[mine], lev)
                made = _batch(keys[mine], values)
                border = pa.array((mine == 0) | (mine == len(keys) - 1))
                yield pa.RecordBatch.from_arrays([*made.columns, border], names=[*made.schema.names, "border"])

    return run


def _climbed(ops: X.Operators, by_level: dict, level: int, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """level, keys, multipoles of the boxes from ``level`` - 1 up to ``top`` above leaves and boxes by level."""
    keys, values = by_level.get(level, (None, None))
    for lev in range(level, top, -1):
        found, sums = X.up(ops, keys, values, lev) if keys is not None else (None, None)
        if found is not None:
            yield lev - 1, found, sums
        more, theirs = by_level.get(lev - 1, (None, None))
        if found is None or more is None:
            keys, values = (found, sums) if more is None else (more, theirs)
        else:
            keys, values = np.concatenate([found, more]), np.concatenate([sums, theirs])


def _m2m(ops: X.Operators, level: int, top: int, n_vecs: int, clock: Clock):
    """Boxes from ``level`` - 1 up to ``top`` above rows key, level, coeff, coeff_im, above, sorted by (above, key): whole sub-trees at a time,
    the last one of a batch waits for the next."""
    for lev in range(level, top, -1):
        ops.m2m(lev)
    ops = ops.part("m2m")

    def climb(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        levels = rows.column(rows.schema.get_field_index("level")).to_numpy()
        with clock("m2m"):
            by_level = {lev: _values(rows.filter(pa.array(levels == lev)), n_vecs) for lev in np.unique(levels).tolist()}
            found = [(lev, _batch(keys, values)) for lev, keys, values in _climbed(ops, by_level, level, top)]
        for lev, made in found:
            yield pa.RecordBatch.from_arrays([made.column(0), pa.array(np.full(len(made), lev, np.int32)), made.column(1), made.column(2)], names=["key", "level", "coeff", "coeff_im"]).select(["level", "key", "coeff", "coeff_im"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            above = whole.column(whole.schema.get_field_index("above")).to_numpy()
            last = int(np.flatnonzero(np.r_[True, above[1:] != above[:-1]])[-1])
            held = whole.slice(last)
            if last:
                yield from climb(whole.slice(0, last))
        if held is not None and len(held):
            yield from climb(held)

    return run


def _blocks_down(ops: X.Operators, level: int, n_vecs: int, clock: Clock):
    ops.far(level)
    ops.inverse(level, False)
    if level > 2:
        ops.l2l(level)
    ops = ops.part("inverse", "l2l", far=level)

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        part = lambda k: table.filter(pa.array(kind == k))
        keys = np.sort(part(0).column("key").to_numpy())
        s_keys, s_values = _values(part(1), n_vecs)
        order = np.argsort(s_keys)
        s_keys, s_values = s_keys[order], s_values[order]
        local = np.zeros((len(keys), n_vecs, ops.n_coeffs(level)), ops.dtype)
        if len(s_keys):
            with clock("m2l"):
                local += ops.check_to_local(level, ops.far(level).apply(s_values, s_keys, keys, level))
        if (kind == 3).any():
            p_keys, checks = _sorted(part(3), n_vecs, ops.dtype)
            local[np.searchsorted(keys, p_keys)] += ops.check_to_local(level, checks)
        if (kind == 2).any():
            p_keys, p_values = _values(part(2), n_vecs)
            order = np.argsort(p_keys)
            with clock("l2l"):
                local += X.down(ops, keys, level, p_keys[order], p_values[order])
        return pa.Table.from_batches([_batch(keys, local)], schema=_batch(keys[:0], local[:0]).schema) if len(keys) else pa.Table.from_batches([], schema=_batch(keys, local).schema)

    return run


def _leaf_blocks(ops: X.Operators, domain, vecs: list[int], gradient: bool, clock: Clock):
    depth, ops = ops.depth, ops.part()

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        frame = table.filter(pa.array(kind < 2)).select(["kind", "key", "gid", "x", "y", "z", "vec_idx", "q", "q_im"]).to_pandas()
        targets = frame[frame.kind == 0].sort_values("key", kind="stable")
        sources = frame[frame.kind == 1]
        by_leaf = {k: charge_matrix(p, vecs, ops.kernel.complex) for k, p in sources.groupby("key")}
        locals_ = {}
        if (kind == 2).any():
            locals_ = dict(zip(*_values(table.filter(pa.array(kind == 2)), len(vecs)), strict=True))
        out = []
        for key, part in targets.groupby("key"):
            xyz = part[["x", "y", "z"]].to_numpy(float)
            found = [by_leaf[k] for k in leaves_around(key).tolist() if k in by_leaf]
            sums = np.zeros((4 if gradient else 1, len(part), len(vecs)), ops.result_dtype)
            if found:
                with clock("p2p"):
                    e = kernels.evaluate(ops.kernel, xyz, np.concatenate([s for s, _ in found]), np.concatenate([q for _, q in found]), gradient)
                sums += e if gradient else e[None]
            if key in locals_:
                centre = X.centres(np.array([key]), depth, domain.origin, domain.side)[0]
                with clock("l2p"):
                    sums += ops.l2p(xyz, locals_[key].T, centre, depth, gradient)
            out.append(result_batch(part.gid.to_numpy(), vecs, sums, ops.kernel, gradient))
        empty = result_batch(np.empty(0, np.int64), vecs, np.zeros((4 if gradient else 1, 0, len(vecs)), ops.result_dtype), ops.kernel, gradient)
        return pa.Table.from_batches(out, schema=empty.schema)

    return run
