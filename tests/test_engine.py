"""Keys, trees, lists, numerics and fast sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import kernels, linalg, surfaces
from orbweave.functions import morton as M
from orbweave.operators import domain as D
from orbweave.operators import interactions as I
from orbweave.operators import keysets as K
from orbweave.operators import trees as T
from orbweave.plans import engine, search
from orbweave.plans import translations as X
from orbweave.sources import fixtures, stl
from orbweave.streaming.reevaluate import evaluate_stream


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def long(x):
    return F.lit(x).cast("long")


def test_golden_keys(spark):
    row = one(spark, a=M.encode(long(1 << 15), long(0), long(1 << 15), 1), b=M.encode(long(3 << 14), long(3 << 14), long(3 << 14), 2))
    assert row.a >> 15 == 0b101 << 45 and row.a & 0x7FFF == 1
    assert row.b >> 15 == 0b111111 << 42 and row.b & 0x7FFF == 2
    small = one(spark, a=M.encode(long(1), long(0), long(1), 1), b=M.encode(long(3), long(3), long(3), 2))
    assert (small.a, small.b) == (163841, 0b111111000000000000010)


def test_key_round_trip_and_limits(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(int, rng.integers(0, 1 << 16, 3))) for _ in range(50)] + [(0, 0, 0), (65535, 65535, 65535)]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("k", M.encode(F.col("x"), F.col("y"), F.col("z"), 16))
    back = df.select("x", "y", "z", *[a.alias(f"b{i}") for i, a in enumerate(M.anchor(F.col("k")))], "k").collect()
    assert all((r.x, r.y, r.z) == (r.b0, r.b1, r.b2) and r.k >= 0 for r in back)
    keys = np.array([r.k for r in back])
    assert (X.key_of(np.array(rows), 16) == keys).all() and (X.grid(keys, 16) == np.array(rows)).all()


def test_family_and_root(spark):
    root = long(0)
    row = one(spark, parent=M.parent(root), kids=M.children(root), up=M.parent(F.element_at(M.children(root), 8)), near=F.size(M.neighbours(root)), last=M.finest_last_child(root), sib=F.size(M.siblings(root)))
    assert row.parent is None and row.up == 0 and len(row.kids) == 8 and row.kids == sorted(row.kids) and row.near == 0 and row.sib == 1
    assert row["last"] == 9223372036854743056
    assert one(spark, n=F.size(M.descendants(root, 3))).n == 512
    with pytest.raises(Exception, match="deepest"):
        spark.range(1).select(M.descendants(long(16), 1)).collect()


def test_neighbours_with_missing(spark):
    corner = M.encode(long(0), long(0), long(0), 3)
    row = one(spark, some=M.neighbours(corner), whole=M.neighbours(corner, missing=True))
    assert len(row.some) == 7 and len(row.whole) == 26 and sum(x is None for x in row.whole) == 19


def test_blocks_around(spark):
    """Against cells, for all boxes of some levels and for domains of one block."""
    for level, reach, block in ((3, 1, 1), (3, 3, 0), (4, 3, 1), (1, 1, 0), (0, 1, 0)):
        n, edge = 1 << level, 1 << (level - block)
        cells = np.array([(a, b, c) for a in range(n) for b in range(n) for c in range(n)])[:: 7 if level > 3 else 1]
        keys = X.key_of(cells, level)
        found = spark.createDataFrame([(int(k),) for k in keys], "key long").select("key", M.blocks_around(F.col("key"), reach, block).alias("b")).collect()
        for (key, blocks), cell in zip(sorted(found), cells[np.argsort(keys)], strict=True):
            axes = [sorted({x // edge for x in range(max(0, c - reach), min(n - 1, c + reach) + 1)}) for c in cell]
            expected = X.key_of(np.array([(a, b, c) for a in axes[0] for b in axes[1] for c in axes[2]]), block)
            assert sorted(blocks) == sorted(expected.tolist()) and len(set(blocks)) == len(blocks)


def test_clusters_match_pairs():
    """The product of families of children against the sum over all pairs of the far list, on a sparse set of boxes."""
    rng = np.random.default_rng(3)
    for kernel, level in ((kernels.Laplace(), 3), (kernels.Helmholtz(2.5), 2)):
        sources, targets = (np.unique(X.key_of(rng.integers(0, 1 << level, (40, 3)), level)) for _ in range(2))
        q = rng.standard_normal((len(sources), 1, surfaces.n_coeffs(3))).astype(complex if kernel.complex else float)
        fft, dense = (X.Operators(kernel, 1.0, 3, [3], m2l).far(level).apply(q, sources, targets, level) for m2l in (X.Fft(block_size=7), X.Dense()))
        assert np.allclose(fft, dense, atol=1e-10 * np.abs(dense).max())


def test_transfer_vectors(spark):
    found = [(r.dx, r.dy, r.dz) for r in K.transfer_vectors(spark).collect()]
    assert len(found) == 316 and sorted(found) == sorted(X.OFFSETS)
    with pytest.raises(Exception, match="level 2"):
        spark.range(1).select(*M.transfer_components(long(1), long(1))).collect()


def test_complete_region_fills_between():
    depth = 3
    keys = [int(k) for k in X.key_of(np.array([[0, 0, 1], [5, 3, 2]]), depth)]
    found = K.complete_region(*keys)
    cells = {tuple(c) for c in X.grid(np.array(keys), depth)}
    for k in found:
        level = k & 0x7FFF
        low = X.grid(np.array([k]), level)[0] << (depth - level)
        n = 1 << (depth - level)
        own = {(low[0] + a, low[1] + b, low[2] + c) for a in range(n) for b in range(n) for c in range(n)}
        assert not own & cells
        cells |= own
    order = sorted(int(k) for k in X.key_of(np.array(sorted(cells)), depth))
    every = sorted(int(k) for k in X.key_of(np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)]), depth))
    assert order == every[every.index(keys[0]) : every.index(keys[1]) + 1]


def test_complete_block_tree_covers_domain(spark):
    seeds = [int(k) for k in X.key_of(np.array([[1, 2, 3], [6, 1, 0]]), 3)]
    found = [r.key for r in K.complete_block_tree(spark.createDataFrame([(k,) for k in seeds], "key long")).collect()]
    assert sum(8.0 ** -(k & 0x7FFF) for k in found) == 1.0 and set(seeds) <= set(found)


def test_balance(spark):
    deep = int(X.key_of(np.array([[7, 7, 7]]), 4)[0])
    found = [r.key for r in K.balance(spark.createDataFrame([(deep,)], "key long")).collect()]
    boxes = [(X.grid(np.array([k]), k & 0x7FFF)[0], k & 0x7FFF) for k in found]
    for c, lev in boxes:
        for d, other in boxes:
            if abs(lev - other) > 1:
                a, b = c / 2**lev, d / 2**other
                assert not all(x <= y + 2.0**-other and y <= x + 2.0**-lev for x, y in zip(a, b, strict=True))


def test_domain_and_bad_input(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 2.0, 4.0)], "gid long, x double, y double, z double")
    found = D.domain_of(points)
    assert found.origin == pytest.approx((-0.02, -0.02, -0.02)) and found.side == pytest.approx(4.04)
    with pytest.raises(ValueError, match="no points"):
        D.domain_of(points.limit(0))
    with pytest.raises(ValueError, match="lack"):
        schemas.points(points.drop("z"))
    with pytest.raises(ValueError, match="depth"):
        T.build(points, 17)
    with pytest.raises(Exception, match="without coordinates"):
        schemas.points(spark.sql("SELECT 1L gid, CAST(NULL AS DOUBLE) x, 0D y, 0D z")).collect()
    with pytest.raises(Exception, match="not in Domain"):
        T.keyed(points, D.Domain((0.0, 0.0, 0.0), 1.0), 2).collect()


def test_tree_accessors(spark):
    points = fixtures.uniform(spark, 300, seed=4).persist()
    tree = T.build(points, 2)
    assert tree.n_coordinates() == 300 and tree.n_keys(0) == 1
    leaf = tree.points.first()["leaf_key"]
    assert tree.n_coordinates(leaf) == tree.leaf_points(leaf).count() > 0
    assert tree.node(0) == 0 and tree.root() == 0
    assert T.partitioned(tree, "simplesort", 3).points.count() == 300
    with pytest.raises(ValueError):
        T.partitioned(tree, "bogosort")


def test_fixtures(spark):
    r = fixtures.sphere(spark, 50).selectExpr("max(abs(x*x+y*y+z*z-1)) AS e").first().e
    assert r < 1e-12
    col = fixtures.column(spark, 50).selectExpr("max(x) a", "max(z) b").first()
    assert col.a <= 0.1 and 1 < col.b <= 500
    ids = fixtures.dense_ids(fixtures.uniform(spark, 40).drop("gid"), ["x", "y", "z"]).select("gid").orderBy("gid").collect()
    assert [r.gid for r in ids] == list(range(40))


def test_stl(spark, tmp_path):
    tri = np.zeros(2, stl._TRIANGLE)
    tri["corners"] = [[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[1, 0, 0], [0, 1, 0], [1, 1, 0]]]
    (tmp_path / "a.stl").write_bytes(b"\0" * 80 + (2).to_bytes(4, "little") + tri.tobytes())
    rows = stl.read_stl(spark, str(tmp_path / "a.stl")).collect()
    assert len(rows) == 4 and sorted(len(r.faces) for r in rows) == [1, 1, 2, 2]
    shared = stl.read_stl(spark, str(tmp_path / "*.stl")).orderBy("gid").collect()
    assert [r.gid for r in shared] == [0, 1, 2, 3] and [(r.x, r.y) for r in shared] == [(0, 0), (0, 1), (1, 0), (1, 1)] and shared[1].faces == [0, 1]
    tri["corners"][1] = tri["corners"][0, [0, 0, 1]]  # a triangle with a corner twice counts once
    (tmp_path / "b.stl").write_bytes(b"\0" * 80 + (2).to_bytes(4, "little") + tri.tobytes())
    both = stl.read_stl(spark, str(tmp_path / "*.stl")).collect()
    assert sorted(r.gid for r in both if r.path.endswith("b.stl")) == [0, 1, 2] and sorted(r.faces for r in both if r.path.endswith("b.stl")) == [[0], [0, 1], [0, 1]]
    text = b"solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid"
    assert stl.corners(text).shape == (1, 3, 3)


def test_linear_algebra():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 30))
    left, right = linalg.pinv(a)
    assert np.allclose(a @ (left @ right) @ a, a)
    left, right = linalg.pinv_aca(a)
    assert np.allclose(a @ (left @ right) @ a, a)
    for u, s, vh in (linalg.rsvd(a, 6), linalg.rsvd_to_error(a, 1e-9)):
        assert np.allclose((u * s) @ vh, a)
    grid = np.linspace(0, 1, 60)[:, None] * [1.0, 1, 1]
    k = kernels.Laplace().matrix(grid + [3.0, 0, 0], grid)
    u, v = linalg.aca(lambda i: k[i], lambda j: k[:, j], k.shape, 1e-10)
    assert u.shape[1] < 20 and np.linalg.norm(u @ v - k) < 1e-8 * np.linalg.norm(k)
    assert linalg.cutoff_rank(np.array([3.0, 2, 1]), 0.5) == 3 and linalg.cutoff_rank(np.array([1.0]), 5) == 1
    x = rng.standard_normal((2, 6, 6, 6))
    assert np.allclose(linalg.irfft3(linalg.rfft3(x), 6), x)
    z = x + 1j * x[::-1]
    assert np.allclose(linalg.irfft3(linalg.rfft3(z), 6, real=False), z)
    assert linalg.flip3(np.arange(8).reshape(2, 2, 2)).ravel().tolist() == [7, 6, 5, 4, 3, 2, 1, 0]
    m, v = rng.standard_normal((5, 8, 8)), rng.standard_normal((5, 8, 2))
    assert np.allclose(linalg.hadamard8x8(m, v, 2.0)[2, 3], 2 * m[2, :, 3] @ v[2])


def test_surfaces():
    assert [surfaces.n_coeffs(p) for p in (2, 3, 6, 10)] == [8, 26, 152, 488]
    assert len(surfaces.surface_grid(4)) == surfaces.n_coeffs(4)
    with pytest.raises(ValueError):
        surfaces.n_coeffs(1)


def test_gradient_is_derivative():
    rng = np.random.default_rng(1)
    t, s, h = rng.random((4, 3)), rng.random((5, 3)) + 2, 1e-6
    for kernel in (kernels.Laplace(), kernels.Helmholtz(2.5)):
        g = kernel.matrix(t, s, True)
        for axis in range(3):
            e = np.eye(3)[axis] * h
            assert np.allclose((kernel.matrix(t + e, s) - kernel.matrix(t - e, s)) / (2 * h), g[1 + axis], atol=1e-7)
        assert (kernel.matrix(t, t).diagonal() == 0).all()


CASES = {
    "laplace-fft": (kernels.Laplace(), 3, 6, X.Fft(), 1, "Value", 4096, 1e-5),
    "laplace-gradient": (kernels.Laplace(), 3, 6, X.Fft(), 1, "ValueDeriv", 4096, 1e-6),
    "laplace-aca-deep-joins": (kernels.Laplace(), 3, 5, X.Aca(1e-8), 2, "Value", 16, 1e-5),
    "laplace-sarcmp": (kernels.Laplace(), 2, 5, X.SaRcmp(1e-7, surface_diff=1), 2, "Value", 4096, 1e-5),
    "laplace-random-svd": (kernels.Laplace(), 2, 4, X.SaRcmp(1e-7, svd=X.RandomSvd(56)), 1, "Value", 4096, 1e-3),
    "laplace-random-svd-to-error": (kernels.Laplace(), 2, 4, X.SaRcmp(1e-9, svd=X.RandomSvd(tolerance=1e-8)), 1, "Value", 4096, 1e-3),
    "laplace-variable": (kernels.Laplace(), 3, [5, 6, 5, 6], X.Fft(), 1, "Value", 4096, 1e-3),
    "laplace-dense-pinv-aca": (kernels.Laplace(), 2, 4, X.Dense(), 1, "Value", 4096, 1e-3),
    "helmholtz-fft-deep-joins": (kernels.Helmholtz(2.5), 3, 5, X.Fft(), 1, "Value", 16, 1e-4),
    "helmholtz-ia": (kernels.Helmholtz(2.5), 2, 4, X.Ia(1e-7), 2, "Value", 4096, 1e-3),
    "flat": (kernels.Laplace(), 1, 4, X.Fft(), 1, "Value", 4096, 1e-12),
    "single-box": (kernels.Laplace(), 0, 4, X.Fft(), 1, "Value", 4096, 1e-12),
}


@pytest.mark.parametrize("case", CASES)
def test_fast_sum(spark, case):
    kernel, depth, order, m2l, n_vecs, kind, limit, tolerance = CASES[case]
    sources, targets = fixtures.uniform(spark, 900, seed=1).persist(), fixtures.uniform(spark, 700, seed=2).persist()
    charges = fixtures.unit_charges(sources, n_vecs)
    pinv = X.Pinv(aca="pinv-aca" in case)
    plan = engine.Builder(spark).tree(sources, targets, depth=depth).parameters(charges, order, kernel, kind, m2l, pinv).build()
    plan.driver_boxes = limit
    found = plan.evaluate().persist()
    exact = I.direct(targets, sources, schemas.charges(charges), kernel, kind != "Value").persist()
    assert found.count() == 700 * n_vecs
    for name in kernels.result_columns(kernel, kind != "Value"):
        assert I.l2_error(found, exact, name).first()[0] <= tolerance * (1 if name == "phi" else 100)


ACCURACY = {
    "laplace": (kernels.Laplace(), 6, X.Fft(), 1, "ValueDeriv", 1e-5, 1e-4),
    "laplace-variable-surfaces": (kernels.Laplace(), 6, X.SaRcmp(1e-9, surface_diff=2), 1, "Value", 1e-6, None),
    "helmholtz": (kernels.Helmholtz(2.5), 6, X.Fft(), 1, "ValueDeriv", 1e-5, 1e-3),
    "helmholtz-many": (kernels.Helmholtz(2.5), 6, X.Ia(1e-8), 2, "Value", 1e-5, None),
}


@pytest.mark.parametrize("case", ACCURACY)
def test_accuracy_on_thousands_of_points(spark, case):
    """9,000 sources, 10,000 targets, leaves of 150 points: relative errors of all potentials and gradients."""
    kernel, order, m2l, n_vecs, kind, tolerance, slope = ACCURACY[case]
    sources, targets = fixtures.uniform(spark, 9000, seed=1).persist(), fixtures.uniform(spark, 10_000, seed=2).persist()
    charges = fixtures.unit_charges(sources, n_vecs)
    plan = engine.Builder(spark).tree(sources, targets, n_crit=150).parameters(charges, order, kernel, kind, m2l).build()
    found = plan.evaluate().persist()
    exact = I.direct(targets, sources, schemas.charges(charges), kernel, kind != "Value").persist()
    assert found.count() == 10_000 * n_vecs
    for name in kernels.result_columns(kernel, kind != "Value"):
        assert I.l2_error(found, exact, name).first()[0] <= (slope if name.startswith("g") else tolerance)


def test_points_and_charges_have_to_be_there(spark):
    points = fixtures.uniform(spark, 60).persist()
    for bad in (points.union(points.limit(1)), points.union(spark.sql("SELECT CAST(NULL AS LONG), 0.5D, 0.5D, 0.5D"))):
        with pytest.raises(ValueError, match="different gids"):
            engine.Builder(spark).tree(bad, points, depth=2)
    few = fixtures.unit_charges(points.filter("gid < 50"))
    plan = engine.Builder(spark).tree(points, points, depth=2).parameters(few, 3, kernels.Laplace()).build()
    with pytest.raises(Exception, match="source without a charge"):
        plan.evaluate().collect()


def test_direct_and_fast_potentials_agree(spark):
    points = fixtures.uniform(spark, 400, seed=4).persist()
    ones = fixtures.unit_charges(points)
    near, fast = (search.potentials(spark, points, points, ones, direct_pairs=n, n_crit=20) for n in (10**6, 0))
    assert I.l2_error(fast, near).first()[0] < 1e-5


def test_crowded_blocks_and_blocked_direct_sums(spark):
    """A third of the points in one leaf; groups split far below their usual bounds."""
    spread = fixtures.uniform(spark, 300, seed=1)
    heap = fixtures.uniform(spark, 150, 0.4, 0.41, seed=2).withColumn("gid", F.col("gid") + 1000)
    points = spread.union(heap).persist()
    charges = fixtures.unit_charges(points)
    exact = I.direct(points, points, schemas.charges(charges), kernels.Laplace(), True).persist()
    blocked = I.direct(points, points, schemas.charges(charges), kernels.Laplace(), True, block=60)
    assert I.l2_error(blocked, exact).first()[0] < 1e-12 and I.l2_error(blocked, exact, "gy").first()[0] < 1e-12
    plan = engine.Builder(spark).tree(points, points, global_depth=1, local_depth=2, sort="simplesort").parameters(charges, 5, kernels.Laplace(), "ValueDeriv").build()
    plan.near_points = 40
    found = plan.evaluate().persist()
    assert found.count() == 450 and I.l2_error(found, exact).first()[0] < 1e-5
    with pytest.raises(ValueError, match="both"):
        engine.Builder(spark).tree(points, points, global_depth=1)


def test_tasks_get_their_operators_only():
    import pickle

    ops = X.Operators(kernels.Laplace(), 1.0, 3, [5], X.Dense())
    for level in (2, 3):
        ops.far(level), ops.inverse(level, False)
    whole = len(pickle.dumps(ops))
    assert len(pickle.dumps(ops.part())) < 2000 and len(pickle.dumps(ops.part("inverse"))) < whole / 5
    assert len(pickle.dumps(ops.part(far=3))) < 1.01 * whole


def test_reattach_access_and_stream(spark, tmp_path):
    points = fixtures.uniform(spark, 400, seed=1).persist()
    charges = points.select("gid", F.lit(1.0).alias("q"))
    plan = engine.Builder(spark, timed=True).tree(points, points, n_crit=50).parameters(charges, 4, kernels.Laplace()).build()
    assert plan.depth == 1 or plan.depth == 2
    first = plan.evaluate().agg(F.sum("phi")).first()[0]
    again = plan.attach_charges_unordered(charges.withColumn("q", F.lit(2.0))).evaluate().agg(F.sum("phi")).first()[0]
    assert again == pytest.approx(2 * first)
    ranked = plan.source_tree.global_indices().select("rank", F.lit(3.0).alias("q"))
    assert plan.attach_charges_ordered(ranked).evaluate().agg(F.sum("phi")).first()[0] == pytest.approx(3 * first)
    with pytest.raises(ValueError, match="right-hand"):
        plan.attach_charges_unordered(fixtures.unit_charges(points, 2))
    root = plan.multipole(0).first()
    assert len(root["coeff"]) == plan.n_coeffs(0)
    far = np.array([[1e5, 0.0, 0.0]])
    at = surfaces.scaled_surface(4, np.array(plan.domain.origin) + plan.domain.side / 2, plan.domain.side, surfaces.INNER)
    assert kernels.Laplace().matrix(far, at)[0] @ root["coeff"] == pytest.approx(400 / (4 * np.pi * 1e5), rel=1e-4)
    leaf = plan.target_tree.points.first()["leaf_key"]
    assert plan.potential(leaf).count() == plan.target_tree.n_coordinates(leaf)
    assert search.timings(plan).count() > 2
    plan.evaluate()
    took = plan.operator_times()
    assert set(engine.OPERATORS) <= set(took) and took["p2m"] > 0 and took["p2p"] > 0
    charges.coalesce(1).write.parquet(str(tmp_path / "charges"))
    seen = []
    evaluate_stream(plan, spark.readStream.schema(charges.schema).parquet(str(tmp_path / "charges")), lambda df, n: seen.append(df.count()), checkpointLocation=str(tmp_path / "state")).awaitTermination()
    assert seen == [400]


def test_plan_errors(spark):
    points = fixtures.uniform(spark, 50).persist()
    b = engine.Builder(spark)
    for bad in ({}, {"n_crit": 5, "depth": 2}):
        with pytest.raises(ValueError, match="exactly one"):
            b.tree(points, points, **bad)
    b.tree(points, points, depth=2)
    ones = fixtures.unit_charges(points)
    with pytest.raises(ValueError, match="orders"):
        b.parameters(ones, [4, 4], kernels.Laplace())
    with pytest.raises(ValueError, match="right-hand"):
        b.parameters(fixtures.unit_charges(points, 2), 4, kernels.Laplace(), "Value", X.Fft())
    with pytest.raises(ValueError, match="homogeneous"):
        b.parameters(ones, 4, kernels.Laplace(), "Value", X.Ia())
    with pytest.raises(ValueError, match="eval_type"):
        b.parameters(ones, 4, kernels.Laplace(), "Hessian")


def test_grid_search_and_csv(spark, tmp_path):
    points = fixtures.uniform(spark, 200, seed=3).persist()
    found = search.grid_search(spark, points, points, fixtures.unit_charges(points), orders=(3, 5), depths=(2,)).orderBy("order")
    search.write_csv(found, str(tmp_path / "grid"))
    rows = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "grid")).orderBy("order").collect()
    assert [r.order for r in rows] == [3, 5] and rows[0].l2_error > rows[1].l2_error > 0
