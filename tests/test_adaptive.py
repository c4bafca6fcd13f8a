"""Adaptive trees, their lists, and sums over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import kernels, surfaces
from orbweave.functions import morton as M
from orbweave.operators import adaptive
from orbweave.operators import interactions as I
from orbweave.operators.domain import domain_of
from orbweave.plans import translations as X
from orbweave.plans.adaptive import AdaptiveBuilder, above, touching
from orbweave.sources import fixtures


def clustered(spark, n=900, seed=1):
    """A third of the points in a hundredth of an edge, the rest spread."""
    heap = fixtures.uniform(spark, n // 3, 0.41, 0.42, seed=seed + 10).withColumn("gid", F.col("gid") + 100_000)
    return fixtures.uniform(spark, n - n // 3, seed=seed).union(heap).persist()


SETS = {
    "clustered": lambda spark, seed: clustered(spark, seed=seed),
    "column": lambda spark, seed: fixtures.column(spark, 900, seed=seed).persist(),
    "sphere": lambda spark, seed: fixtures.sphere(spark, 900, seed=seed).persist(),
}


def brute_lists(source_leaves, target_leaves):
    """All three lists from all pairs of boxes."""
    up = lambda keys: np.array(sorted({b for k in keys for b in [k, *ancestors(k)]}), np.int64)
    level = lambda k: k & 0x7FFF

    def finer(leaves, boxes):
        out, boxes = set(), boxes[level(boxes) > 0]
        for leaf in leaves:
            hit = (level(boxes) > level(leaf)) & ~touching(leaf, boxes) & touching(leaf, above(boxes)) & (level(above(boxes)) >= level(leaf))
            out |= {(leaf, int(b)) for b in boxes[hit]}
        return out

    u = {(t, int(s)) for t in target_leaves for s in np.array(source_leaves)[touching(t, np.array(source_leaves))]}
    return u, finer(target_leaves, up(source_leaves)), {(b, s) for s, b in finer(source_leaves, up(target_leaves))}


def ancestors(key):
    out = []
    while key & 0x7FFF:
        low = 15 + 3 * (17 - (key & 0x7FFF))
        key = key >> low << low | (key & 0x7FFF) - 1
        out.append(key)
    return out


@pytest.mark.parametrize("name", SETS)
def test_lists(spark, name):
    sources, targets = SETS[name](spark, 1), SETS[name](spark, 2)
    domain = domain_of(sources).union(domain_of(targets))
    s, t = adaptive.build(sources, targets, 15 if name == "sphere" else 60, domain)
    mine = [[r.key for r in tree.boxes.filter("is_leaf").collect()] for tree in (s, t)]
    assert len({k & 0x7FFF for k in mine[0]}) > 1
    for tree, points in ((s, sources), (t, targets)):
        assert tree.points.count() == 900 and tree.boxes.agg(F.sum("n_points")).first()[0] == 900
        wrong = tree.points.filter(~M.is_ancestor(F.col("leaf_key"), F.col("base_key"))).count()
        assert wrong == 0 and tree.points.select("gid").exceptAll(points.select("gid")).count() == 0
    u, w, x = brute_lists(*mine)
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    leaves = [tree.boxes.filter("is_leaf").select("key") for tree in (s, t)]
    assert pairs(I.mixed_u_list(leaves[1], leaves[0])) == sorted(u)
    assert pairs(I.w_list(leaves[1], s.boxes.select("key"))) == sorted(w)
    assert pairs(I.x_list(t.boxes.select("key"), leaves[0])) == sorted(x)
    assert w or name != "clustered"


CASES = {
    "clustered": ("clustered", kernels.Laplace(), 6, X.Fft(), 1, "ValueDeriv", 1e-5),
    "column": ("column", kernels.Laplace(), 6, X.Fft(), 1, "Value", 1e-5),
    "sphere-many": ("sphere", kernels.Laplace(), 6, X.Aca(1e-9), 2, "Value", 1e-5),
    "clustered-helmholtz": ("clustered", kernels.Helmholtz(2.5), 5, X.Fft(), 1, "Value", 1e-4),
}


@pytest.mark.parametrize("case", CASES)
def test_sums(spark, case):
    name, kernel, order, m2l, n_vecs, kind, tolerance = CASES[case]
    sources, targets = SETS[name](spark, 1), SETS[name](spark, 2)
    charges = fixtures.unit_charges(sources, n_vecs)
    plan = AdaptiveBuilder(spark).tree(sources, targets, n_crit=60).parameters(charges, order, kernel, kind, m2l).build()
    found = plan.evaluate()
    exact = I.direct(targets, sources, schemas.charges(charges), kernel, kind != "Value").persist()
    assert found.count() == targets.count() * n_vecs
    for value in kernels.result_columns(kernel, kind != "Value"):
        assert I.l2_error(found, exact, value).first()[0] <= tolerance * (1 if value == "phi" else 100)
    if name == "clustered":
        assert plan.w_list().count() and plan.x_list().count()
        groups = plan.target_tree.boxes.filter("is_leaf").agg(F.max("n_points")).first()[0]
        assert groups <= 60 and plan.crowded() is None


def test_crowded_leaf_at_the_deepest_level(spark):
    """Points in one place can't be told apart by boxes: their block is split over groups of bounded size."""
    same = spark.range(200).select((F.col("id") + 5000).alias("gid"), F.lit(0.3).alias("x"), F.lit(0.3).alias("y"), F.lit(0.3).alias("z"))
    points = fixtures.uniform(spark, 300, seed=1).union(same).persist()
    charges = fixtures.unit_charges(points)
    plan = AdaptiveBuilder(spark).tree(points, points, n_crit=100).parameters(charges, 5, kernels.Laplace()).build()
    plan.near_points = 120
    assert plan.depth == 16 and plan.crowded() is not None
    found = plan.evaluate()
    exact = I.direct(points, points, schemas.charges(charges), kernels.Laplace())
    assert found.count() == 500 and I.l2_error(found, exact).first()[0] < 1e-5


def test_few_points_and_errors(spark):
    points = fixtures.uniform(spark, 12, seed=3).persist()
    ones = fixtures.unit_charges(points)
    plan = AdaptiveBuilder(spark).tree(points, points, n_crit=50).parameters(ones, 4, kernels.Laplace()).build()
    assert plan.depth == 0
    exact = I.direct(points, points, schemas.charges(ones), kernels.Laplace())
    assert I.l2_error(plan.evaluate(), exact).first()[0] < 1e-12
    with pytest.raises(ValueError, match="different gids"):
        AdaptiveBuilder(spark).tree(points.union(points.limit(1)), points)
    with pytest.raises(ValueError, match="n_crit"):
        AdaptiveBuilder(spark).tree(points, points, n_crit=0)


def test_points_to_locals_and_multipoles_to_points():
    """A single X pair and a single W pair against the sums themselves."""
    rng = np.random.default_rng(0)
    for kernel in (kernels.Laplace(), kernels.Helmholtz(2.0)):
        ops = X.Operators(kernel, 1.0, 4, [7], X.Dense())
        level, side = 3, 1 / 8
        centre = np.array([[0.5, 0.5, 0.5]]) + side / 2
        inside = centre + (rng.random((40, 3)) - 0.5) * side
        outside = centre + np.array([2 * side, 0, 0]) + (rng.random((30, 3)) - 0.5) * side
        q = rng.random((30, 2)).astype(ops.dtype)
        local = ops.check_to_local(level, ops.p2l(outside, q, centre, np.array([30]), level))[0].T
        exact = kernels.evaluate(kernel, inside, outside, q)
        assert np.abs(ops.l2p(inside, local, centre[0], level, False)[0] - exact).max() < 1e-5 * np.abs(exact).max()
        q = rng.random((40, 2)).astype(ops.dtype)
        multipole = ops.p2m(inside, q, centre, np.array([40]), level)
        exact = kernels.evaluate(kernel, outside, inside, q, True)
        assert np.abs(ops.m2p(outside, multipole, centre, level, True) - exact).max() < 1e-4 * np.abs(exact).max()
    assert surfaces.n_coeffs(7) == multipole.shape[2]
