"""Checked ids and charges, changed charges, access to single boxes, kernels of a user's own, matrices that are never formed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import kernels, linalg
from orbweave.operators import interactions as I
from orbweave.operators import trees as T
from orbweave.operators.domain import domain_of
from orbweave.plans import engine, search
from orbweave.plans import translations as X
from orbweave.plans.adaptive import AdaptiveBuilder
from orbweave.sources import fixtures
from orbweave.streaming.reevaluate import evaluate_stream


def test_direct_sums_check_ids_and_charges_on_every_path(spark):
    points = fixtures.uniform(spark, 60).persist()
    ones = schemas.charges(fixtures.unit_charges(points))
    domain = domain_of(points)
    placed = lambda p: T.keyed(p, domain, 2)
    ways = {
        "broadcast": lambda t, s, q: I.direct(t, s, q, kernels.Laplace()),
        "blocks": lambda t, s, q: I.direct(t, s, q, kernels.Laplace(), block=20),
        "sql": lambda t, s, q: I.direct_sql(t, s, q, kernels.Laplace()),
        "near": lambda t, s, q: I.near_field(placed(t), placed(s), q, kernels.Laplace()),
        "potentials, direct": lambda t, s, q: search.potentials(spark, s, t, q, order=3),
        "potentials, fast": lambda t, s, q: search.potentials(spark, s, t, q, order=3, direct_pairs=0),
    }
    twice = points.union(points.limit(1).withColumn("x", F.col("x") / 2))
    null = points.union(spark.sql("SELECT CAST(NULL AS LONG), 0.5D, 0.5D, 0.5D"))
    for name, way in ways.items():
        for bad in (twice, null):
            for pair in ((points, bad), (bad, points)):
                with pytest.raises(ValueError, match="different gids"):
                    way(*pair, ones)
        with pytest.raises(Exception, match="source without a charge"):
            way(points, points, ones.filter("gid < 50")).collect()
        with pytest.raises(Exception, match="source without a charge"):
            way(points, points, ones.withColumn("q", F.when(F.col("gid") < 50, F.col("q")))).collect()
        assert way(points, points, ones.union(ones.withColumn("gid", F.col("gid") + 500))).count() == 60, name  # charges of no source
    halves = ones.withColumn("q", F.lit(0.5))
    both = [{r.gid: r.phi for r in ways[n](points, points, q).collect()} for n in ("broadcast", "blocks", "sql") for q in (ones, halves.union(halves))]
    assert all(np.allclose([b[i] for i in range(60)], [both[0][i] for i in range(60)]) for b in both)


def test_many_right_hand_sides_shrink_the_broadcast(spark, monkeypatch):
    points = fixtures.uniform(spark, 40).persist()
    charges = schemas.charges(fixtures.unit_charges(points, 5))
    exact = I.direct(points, points, charges, kernels.Laplace()).persist()
    monkeypatch.setattr(I, "SOURCE_BYTES", 8 * 8 * 15)  # 15 sources of 3 coordinates and 5 charges
    assert I.l2_error(I.direct(points, points, charges, kernels.Laplace()), exact).first()[0] < 1e-13


@pytest.fixture(scope="module")
def scene(spark):
    sources, targets = fixtures.uniform(spark, 500, seed=1).persist(), fixtures.uniform(spark, 400, seed=2).persist()
    return sources, targets, fixtures.unit_charges(sources, 2).persist()


def plans(spark, scene, m2l=None, order=5):
    sources, targets, charges = scene
    settings = (charges, order, kernels.Laplace(), "Value", m2l or X.Aca(1e-9))
    return {
        "uniform": engine.Builder(spark).tree(sources, targets, depth=3).parameters(*settings).build(),
        "adaptive": AdaptiveBuilder(spark).tree(sources.unionByName(fixtures.uniform(spark, 1, 0.31, 0.32, seed=9).withColumn("gid", F.lit(9999).cast("long"))).filter("gid < 9999"), targets, 40).parameters(*settings).build(),
    }


@pytest.mark.parametrize("kind", ["uniform", "adaptive"])
def test_changed_charges(spark, scene, kind):
    """A few sources of one corner change: the sums are those of a plan with all new charges, and few boxes go up."""
    plan = plans(spark, scene)[kind]
    few = scene[0].filter("x < 0.3 and y < 0.3 and z < 0.3").select("gid")
    changes = few.select("gid", F.lit(1).alias("vec_idx"), (F.col("gid") % 3 * 2.5).alias("q"))
    changed = plan.change_charges(changes)
    new = scene[2].join(changes.withColumnRenamed("q", "n"), ["gid", "vec_idx"], "left").select("gid", "vec_idx", F.coalesce("n", "q").alias("q"))
    whole = plan.attach_charges_unordered(new)
    assert I.l2_error(changed.evaluate(), whole.evaluate()).first()[0] < 1e-12
    assert I.l2_error(changed.evaluate(), plan.evaluate()).first()[0] > 1e-3  # the old plan keeps its charges
    assert 0 < changed.touched[0] < changed.touched[1] / 4
    for level in (2, plan.depth):
        a, b = ({(r.key, r.vec_idx): np.array(r.coeff) for r in p.multipoles(level).collect()} for p in (changed, whole))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9 * np.abs(b[k]).max()) for k in a)
    again = changed.change_charges(few.select("gid", F.lit(1).alias("vec_idx"), F.lit(2.0).alias("q")))
    assert I.l2_error(again.evaluate(), plan.evaluate()).first()[0] < 1e-12
    assert plan.change_charges(changes.limit(0).union(spark.sql("SELECT 12345L, 1, 3D"))).touched[0] == 0
    with pytest.raises(ValueError, match="right-hand"):
        plan.change_charges(changes.withColumn("vec_idx", F.lit(7)))


@pytest.mark.parametrize("kind", ["uniform", "adaptive"])
def test_access_to_one_leaf(spark, scene, kind):
    """A leaf's potentials and locals without the other targets': no downward pass, no results, same values."""
    plan, whole = plans(spark, scene)[kind], plans(spark, scene)[kind]
    whole.evaluate()
    leaves = [r[0] for r in plan.target_tree.points.select("leaf_key").distinct().orderBy("leaf_key").collect()]
    for leaf in (leaves[0], leaves[len(leaves) // 2]):
        a, b = (p.potential(leaf).toPandas() for p in (plan, whole))
        assert a.gid.tolist() == b.gid.tolist() and len(a) == 2 * plan.target_tree.n_coordinates(leaf) and np.allclose(a.phi, b.phi, rtol=1e-10)
        a, b = ({r.vec_idx: r.coeff for r in p.local(leaf).collect()} for p in (plan, whole))
        assert a.keys() == b.keys() == {0, 1} and all(np.allclose(a[v], b[v], atol=1e-9 * max(map(abs, b[v]))) for v in a)
    assert plan._results is None and plan._locals is None and not [n for n in plan.times if n.startswith("down")]
    assert sum(map(len, X.seen(leaves[0]).values())) <= 189 * plan.depth


def test_clear(spark, scene):
    plan = plans(spark, scene)["uniform"]
    first = plan.evaluate()
    assert plan.evaluate() is first and plan._multipoles is not None
    plan.clear()
    assert plan._multipoles is None and plan._locals is None and plan._results is None
    again = plan.evaluate()
    assert again is not first and I.l2_error(again, first).first()[0] < 1e-13


def test_stream_of_changes(spark, scene, tmp_path):
    sources, targets, charges = scene
    plan = engine.Builder(spark).tree(sources, targets, depth=2).parameters(charges.filter("vec_idx = 0"), 4, kernels.Laplace()).build()
    for i in range(2):
        sources.filter(F.col("gid") % 5 == i).select("gid", F.lit(3.0 + i).alias("q")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    seen = {}
    stream = spark.readStream.schema("gid long, q double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    evaluate_stream(plan, stream, lambda df, n: seen.update({n: df.agg(F.sum("phi")).first()[0]}), changes=True, trigger={"availableNow": True}, checkpointLocation=str(tmp_path / "state")).awaitTermination()
    new = charges.filter("vec_idx = 0").withColumn("q", F.when(F.col("gid") % 5 == 0, 3.0).when(F.col("gid") % 5 == 1, 4.0).otherwise(F.col("q")))
    assert len(seen) == 2 and seen[1] == pytest.approx(plan.attach_charges_unordered(new).evaluate().agg(F.sum("phi")).first()[0])


def test_kernels_are_checked(spark):
    for kernel in (kernels.Laplace(), kernels.Helmholtz(2.5), kernels.Yukawa(0.5)):
        kernels.check(kernel, spark)

    class Wrong(kernels.Laplace):
        degree = -2

    with pytest.raises(ValueError, match="degree"):
        kernels.check(Wrong())

    class Steep(kernels.Yukawa):
        def matrix(self, targets, sources, gradient=False):
            return 2 * super().matrix(targets, sources, gradient)

    kernels.check(Steep(0.5))
    with pytest.raises(ValueError, match="same sums"):
        kernels.check(Steep(0.5), spark)


class Scaled:
    """A user's kernel: 3 / r, homogeneous of degree -1, by the protocol alone."""

    degree, complex = -1, False

    def matrix(self, targets, sources, gradient=False):
        return 12 * np.pi * kernels.Laplace().matrix(targets, sources, gradient)

    def columns(self, *a):
        return {n: F.lit(12 * np.pi) * c for n, c in kernels.Laplace().columns(*a).items()}


@pytest.mark.parametrize("kernel", [kernels.Yukawa(0.3), Scaled()], ids=["yukawa", "scaled"])
def test_a_third_kernel(spark, scene, kernel):
    sources, targets, charges = scene
    charges = charges.filter("vec_idx = 0")
    kernels.check(kernel, spark)
    for builder in (engine.Builder(spark).tree(sources, targets, depth=2), AdaptiveBuilder(spark).tree(sources, targets, 40)):
        plan = builder.parameters(charges, 6, kernel, "ValueDeriv", X.Fft()).build()
        exact = I.direct(targets, sources, schemas.charges(charges), kernel, True).persist()
        assert I.l2_error(plan.evaluate(), exact).first()[0] < 1e-5 and I.l2_error(plan.evaluate(), exact, "gx").first()[0] < 1e-3


class Counting(kernels.Laplace):
    """Counts the entries it is asked for."""

    asked = 0

    def matrix(self, targets, sources, gradient=False):
        Counting.asked += len(targets) * len(sources)
        return super().matrix(targets, sources, gradient)


def test_cross_approximation_never_forms_the_matrix():
    ops = X.Operators(Counting(), 1.0, 3, [8], X.Aca(1e-6))
    for offset in ((2, 0, 0), (3, 3, 3), (0, -2, 1)):
        exact = ops.far_matrix(3, offset)
        Counting.asked = 0
        left, right = X.PairField.piece(ops, 3, offset)
        assert Counting.asked < exact.size / 2
        assert np.linalg.norm(left @ right - exact) < 1e-4 * np.linalg.norm(exact)


def test_pseudo_inverse_of_entries():
    rng = np.random.default_rng(0)
    t, s = rng.random((80, 3)) + [4, 0, 0], rng.random((70, 3))
    Counting.asked = 0
    left, right = linalg.pinv_aca(kernels.entries(Counting(), t, s), eps=1e-8, rtol=1e-7)
    assert Counting.asked < 80 * 70
    a = kernels.Laplace().matrix(t, s)
    assert np.linalg.norm(a @ left @ (right @ a) - a) < 1e-5 * np.linalg.norm(a)


SINGLE = {
    "fft-3": (kernels.Laplace(), 3, X.Fft(), 1e-3),
    "fft-4": (kernels.Laplace(), 4, X.Fft(), 1e-4),
    "aca-4": (kernels.Laplace(), 4, X.Aca(1e-6), 1e-4),
    "stacked-4": (kernels.Laplace(), 4, X.SaRcmp(1e-6), 1e-4),
    "helmholtz-4": (kernels.Helmholtz(2.5), 4, X.Fft(), 1e-3),
}


@pytest.mark.parametrize("case", SINGLE)
def test_single_precision(spark, scene, case):
    """Three and four digits with 32-bit expansions: what is stored and shuffled is half as wide, sums at points are 64-bit."""
    kernel, order, m2l, tolerance = SINGLE[case]
    sources, targets, charges = scene
    charges = charges.filter("vec_idx = 0")
    plan = engine.Builder(spark).tree(sources, targets, depth=3).parameters(charges, order, kernel, "Value", m2l, precision="single").build()
    found = plan.evaluate()
    exact = I.direct(targets, sources, schemas.charges(charges), kernel).persist()
    assert I.l2_error(found, exact).first()[0] < tolerance and found.schema["phi"].dataType.simpleString() == "double"
    for table in (plan._multipoles, plan._locals, plan._level_down(3, plan.target_boxes().filter("level = 3").select("key"), plan._multipoles.filter("level = 3").drop("level"), plan._locals.filter("level = 2").drop("level"))):
        assert table.schema["coeff"].dataType.simpleString() == table.schema["coeff_im"].dataType.simpleString() == "array<float>"
    wide = plan.operators.__class__(kernel, plan.operators.side, 3, [order], m2l)
    assert plan.operators.m2m(3).nbytes * 2 == wide.m2m(3).nbytes and plan.operators.inverse(2, True)[0].dtype.itemsize * 2 == wide.inverse(2, True)[0].dtype.itemsize


def test_single_precision_over_an_adaptive_tree(spark, scene):
    sources, targets, charges = scene
    charges = charges.filter("vec_idx = 0")
    plan = AdaptiveBuilder(spark).tree(sources, targets, 40).parameters(charges, 4, kernels.Laplace(), "ValueDeriv", X.Fft(), precision="single").build()
    exact = I.direct(targets, sources, schemas.charges(charges), kernels.Laplace(), True).persist()
    assert I.l2_error(plan.evaluate(), exact).first()[0] < 1e-4 and I.l2_error(plan.evaluate(), exact, "gz").first()[0] < 1e-2
    with pytest.raises(ValueError, match="precision"):
        AdaptiveBuilder(spark).parameters(charges, 4, kernels.Laplace(), precision="half")


def test_theta_join_of_more_sources_than_one_broadcast(spark, monkeypatch):
    """They go block by chunk; a group has a task of its own."""
    points = fixtures.uniform(spark, 300, seed=3).persist()
    ones = schemas.charges(fixtures.unit_charges(points))
    joined = I.direct_sql(points, points, ones, kernels.Laplace(), True).persist()
    monkeypatch.setattr(I, "SOURCE_BLOCK", 100)
    monkeypatch.setattr(I, "FEW_PAIRS", 1000)
    found = I.direct_sql(points, points, ones, kernels.Laplace(), True).persist()
    assert found.count() == 300 and all(I.l2_error(found, joined, c).first()[0] < 1e-12 for c in ("phi", "gx"))
    blocks = I.direct(points, points, ones, kernels.Laplace(), block=100).persist()
    assert I.l2_error(blocks, joined).first()[0] < 1e-12


def test_near_fields_and_plans_split_blocks_of_many_pairs(spark, monkeypatch):
    """Few points, but more pairs than a task should have: several groups, the same sums, and only targets with sources around."""
    heap = fixtures.uniform(spark, 200, 0.4, 0.6, seed=5)
    lone = fixtures.uniform(spark, 1, 0.95, 0.99, seed=6).withColumn("gid", F.col("gid") + 1000)
    targets, ones = heap.union(lone).persist(), fixtures.unit_charges(heap, 2)
    ones = ones.filter("gid < 150 or vec_idx = 0").persist()
    domain = domain_of(targets)
    t, s = T.keyed(schemas.points(targets), domain, 3).persist(), T.keyed(schemas.points(heap), domain, 3).persist()
    whole = I.near_field(t, s, schemas.charges(ones), kernels.Laplace(), True).persist()
    pairs = t.join(s.select(F.col("leaf_key").alias("source"), F.col("gid").alias("sgid"), *[F.col(c).alias(f"s{c}") for c in "xyz"]), I.M.is_adjacent(F.col("leaf_key"), F.col("source")) | (F.col("leaf_key") == F.col("source")))
    terms = kernels.Laplace().columns(*[F.col(c) - F.col(f"s{c}") for c in "xyz"], F.col("q"), F.col("q_im"))
    expected = pairs.join(schemas.charges(ones).withColumnRenamed("gid", "sgid"), "sgid").groupBy("gid", "vec_idx").agg(*[F.sum(terms[c]).alias(c) for c in ("phi", "gx")]).persist()
    monkeypatch.setattr(I, "FEW_PAIRS", 1000)
    monkeypatch.setattr(I, "TASK_PAIRS", 1 << 12)
    split = I.near_field(t, s, schemas.charges(ones), kernels.Laplace(), True).persist()
    for found in (whole, split):
        assert found.count() == expected.count() <= 400
        assert all(I.l2_error(found, expected, c).first()[0] < 1e-12 for c in ("phi", "gx"))
    plan = engine.Builder(spark).tree(heap, targets, depth=2).parameters(ones, 5, kernels.Laplace(), "Value", X.Aca(1e-9)).build()
    assert plan.crowded()[1] > 4
    assert I.l2_error(plan.evaluate(), I.direct(targets, heap, schemas.charges(ones), kernels.Laplace())).first()[0] < 1e-4
