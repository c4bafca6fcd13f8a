"""Registered queries of the N-body engine and their SQL counterparts (DuckDB).

Keys, counts and lists compare exactly. Floating-point sums depend on their order, so potentials are rounded to 6 decimals
of values of order 1 to 1000 on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import morton as M
from orbweave.functions import surfaces
from orbweave.functions.kernels import FOUR_PI, Helmholtz, Laplace, Yukawa
from orbweave.operators import adaptive as A
from orbweave.operators import domain as D
from orbweave.operators import interactions as I
from orbweave.operators import keysets as K
from orbweave.operators import surfaces as S
from orbweave.operators import trees as T
from orbweave.plans import search
from orbweave.plans import translations as X
from orbweave.plans.adaptive import AdaptiveBuilder
from orbweave.plans.engine import Builder
from orbweave.plans.storage import shared_dir, stored
from orbweave.sources import fixtures, stl, tables

DEPTH = 3
WAVENUMBER, SCREENING = 2.5, 0.5
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- common pieces ---------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    return tables.embeddings(spark, d)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return tables.embeddings(spark, d, 4)


def _domain(spark: SparkSession, d: str) -> D.Domain:
    return D.domain_of(_points(spark, d)).union(D.domain_of(_targets(spark, d)))


def _keyed(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    return T.keyed(schemas.points(_points(spark, d) if points is None else points), _domain(spark, d), DEPTH)


def _charges(points: DataFrame) -> DataFrame:
    return schemas.charges(points.select("gid", "q"))


def _leaves(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    return _keyed(spark, d, points).select(F.col("leaf_key").alias("key")).distinct()


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _axes(*columns) -> list:
    return [c.alias(n) for c, n in zip(columns, ("ax", "ay", "az"), strict=True)]


#: SQL of the derived point sets, their common domain and keys, by sums over single bits.
_SETS = """
src AS (SELECT vec_id AS gid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 1.0::DOUBLE + label AS q FROM embeddings),
tgt AS (SELECT vec_id AS gid, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z, 1.0::DOUBLE + label AS q FROM embeddings),
one AS (SELECT 0 AS s, min(x) AS x, min(y) AS y, min(z) AS z, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM src
  UNION ALL SELECT 1, min(x), min(y), min(z), greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) FROM tgt),
pad AS (SELECT s, x - e * 0.005 AS ox, y - e * 0.005 AS oy, z - e * 0.005 AS oz, e * 1.01 AS side FROM one),
low AS (SELECT min(ox) AS ox, min(oy) AS oy, min(oz) AS oz, max(ox + side) AS tx, max(oy + side) AS ty, max(oz + side) AS tz FROM pad),
dom AS (SELECT ox, oy, oz, greatest(tx - ox, ty - oy, tz - oz) AS side FROM low)"""


def _bits(x: str, y: str, z: str, level: str) -> str:
    """A key from an anchor as a sum of single bits."""
    return f"(((list_sum(list_transform(range(16), lambda b_: ((({x}) >> b_) & 1) << (3 * b_ + 2))) + list_sum(list_transform(range(16), lambda b_: ((({y}) >> b_) & 1) << (3 * b_ + 1))) + list_sum(list_transform(range(16), lambda b_: ((({z}) >> b_) & 1) << (3 * b_))))::BIGINT << 15) + ({level}))::BIGINT"


def _anchors(of: str, depth: int = 16) -> str:
    axis = lambda c: f"(least(floor(({c} - o{c}) / (side / {2**depth})), {2**depth - 1}) * {2 ** (16 - depth)})::BIGINT AS a{c}"
    return f"(SELECT gid, x, y, z, q, {axis('x')}, {axis('y')}, {axis('z')} FROM {of}, dom)"


def _at(axis: str, depth: int) -> str:
    return f"({axis} - {axis} % {1 << (16 - depth)})"


_KEYED = f"""
WITH {_SETS},
src_a AS (SELECT * FROM {_anchors("src")}), tgt_a AS (SELECT * FROM {_anchors("tgt")}),
src_k AS (SELECT *, {_bits("ax", "ay", "az", "16")} AS base_key, {_bits(*[_at(a, DEPTH) for a in ("ax", "ay", "az")], str(DEPTH))} AS leaf_key FROM src_a),
tgt_k AS (SELECT *, {_bits("ax", "ay", "az", "16")} AS base_key, {_bits(*[_at(a, DEPTH) for a in ("ax", "ay", "az")], str(DEPTH))} AS leaf_key FROM tgt_a),
src_c AS (SELECT DISTINCT {", ".join(f"(a{c} >> {16 - DEPTH}) AS c{c}" for c in "xyz")}, leaf_key AS key FROM src_k),
tgt_c AS (SELECT DISTINCT {", ".join(f"(a{c} >> {16 - DEPTH}) AS c{c}" for c in "xyz")}, leaf_key AS key FROM tgt_k)"""

#: Boxes of all levels above occupied leaves as integer cells.
_BOXES = f"""
{_KEYED}, levels AS (SELECT unnest(range(0, {DEPTH + 1}))::INT AS level),
src_b AS (SELECT DISTINCT level, cx >> ({DEPTH} - level) AS cx, cy >> ({DEPTH} - level) AS cy, cz >> ({DEPTH} - level) AS cz FROM src_c, levels),
tgt_b AS (SELECT DISTINCT level, cx >> ({DEPTH} - level) AS cx, cy >> ({DEPTH} - level) AS cy, cz >> ({DEPTH} - level) AS cz FROM tgt_c, levels)"""


def _cell_key(p: str = "", level: str = "level") -> str:
    return _bits(*[f"{p}c{c} << (16 - {p}{level})" for c in "xyz"], f"{p}{level}")


# ---- direct sums ---------------------------------------------------------------------------------------------------------


def _direct_sql(terms: dict[str, str], charges: str = "s.q") -> str:
    sums = ", ".join(f"round(sum({t}), 6) + 0.0 AS {n}" for n, t in terms.items())
    return f"""WITH {_SETS},
p AS (SELECT t.gid, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz, {charges} AS q FROM tgt t, src s),
r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM p)
SELECT gid, 0::INT AS vec_idx, {sums} FROM r GROUP BY gid"""


_LAPLACE = {"phi": f"CASE WHEN r > 0 THEN q / ({FOUR_PI!r} * r) ELSE 0 END"} | {f"g{c}": f"CASE WHEN r > 0 THEN -q * d{c} / ({FOUR_PI!r} * r * r * r) ELSE 0 END" for c in "xyz"}
_HELMHOLTZ = {"phi": f"CASE WHEN r > 0 THEN q * cos({WAVENUMBER} * r) / ({FOUR_PI!r} * r) ELSE 0 END", "phi_im": f"CASE WHEN r > 0 THEN q * sin({WAVENUMBER} * r) / ({FOUR_PI!r} * r) ELSE 0 END"}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Laplace potentials of all sources at all targets."""
    s, t = _points(spark, sf_dir), _targets(spark, sf_dir)
    return _round(I.direct(t, s, _charges(s), Laplace()), "phi")


@query(_direct_sql({"phi": _LAPLACE["phi"]}))
def direct_laplace(spark, d):
    return flagship(spark, d)


@query(_direct_sql({"phi": _LAPLACE["phi"]}))
def direct_laplace_join(spark, d):
    s, t = _points(spark, d), _targets(spark, d)
    return _round(I.direct_sql(t, s, _charges(s), Laplace()), "phi")


@query(_direct_sql({n: t.replace("round(", "round(") for n, t in _LAPLACE.items()}).replace(", 6)", ", 4)"))
def direct_laplace_gradient(spark, d):
    s, t = _points(spark, d), _targets(spark, d)
    return _round(I.direct(t, s, _charges(s), Laplace(), True), "phi", "gx", "gy", "gz", digits=4)


@query(_direct_sql(_HELMHOLTZ))
def direct_helmholtz(spark, d):
    s, t = _points(spark, d), _targets(spark, d)
    return _round(I.direct(t, s, _charges(s), Helmholtz(WAVENUMBER)), "phi", "phi_im")


_YUKAWA = {"phi": f"CASE WHEN r > 0 THEN q * exp(-r / {SCREENING}) / ({FOUR_PI!r} * r) ELSE 0 END"}


@query(_direct_sql(_YUKAWA))
def direct_yukawa(spark, d):
    s, t = _points(spark, d), _targets(spark, d)
    return _round(I.direct(t, s, _charges(s), Yukawa(SCREENING)), "phi")


@query(f"""WITH {_SETS}, v AS (SELECT unnest([0, 1, 2])::INT AS vec_idx)
SELECT t.gid, vec_idx, round(sum(CASE WHEN (t.x - s.x) ** 2 + (t.y - s.y) ** 2 + (t.z - s.z) ** 2 > 0
  THEN s.q * (1 + vec_idx) / ({FOUR_PI!r} * sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2 + (t.z - s.z) ** 2)) ELSE 0 END), 5) + 0.0 AS phi
FROM tgt t, src s, v GROUP BY ALL""")
def direct_many_vectors(spark, d):
    s, t = _points(spark, d), _targets(spark, d)
    charges = schemas.charges(s.select("gid", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("vec_idx"), "q").withColumn("q", F.col("q") * (1 + F.col("vec_idx"))))
    return _round(I.direct(t, s, charges, Laplace()), "phi", digits=5)


@query("""WITH p AS (SELECT p_partkey AS gid, p_size / 50.0::DOUBLE AS x, (p_retailprice::DOUBLE - 900.0) / 100.0 AS y, ((p_partkey * 7919) % 1009) / 1009.0::DOUBLE AS z FROM part),
r AS (SELECT t.gid, sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2 + (t.z - s.z) ** 2) AS r FROM p t, p s)
SELECT gid, 0::INT AS vec_idx, round(sum(CASE WHEN r > 0 THEN 1 / (""" + repr(FOUR_PI) + """ * r) ELSE 0 END), 4) + 0.0 AS phi FROM r GROUP BY gid""")
def direct_parts(spark, d):
    """Potentials of all parts at all parts."""
    p = tables.parts(spark, d)
    return _round(I.direct(p, p, _charges(p), Laplace()), "phi", digits=4)


# ---- domains and keys -----------------------------------------------------------------------------------------------------


@query(f"WITH {_SETS} SELECT round(ox, 9) AS ox, round(oy, 9) AS oy, round(oz, 9) AS oz, round(side, 9) AS side FROM pad WHERE s = 0")
def domain(spark, d):
    return _round(D.extents(schemas.points(_points(spark, d))), "ox", "oy", "oz", "side", digits=9)


@query(f"WITH {_SETS} SELECT round(ox, 9) AS ox, round(oy, 9) AS oy, round(oz, 9) AS oz, round(side, 9) AS side FROM dom")
def domain_union(spark, d):
    both = _domain(spark, d)
    return spark.createDataFrame([(*[round(x, 9) for x in both.origin], round(both.side, 9))], "ox double, oy double, oz double, side double")


@query("""WITH p AS (SELECT l_quantity::DOUBLE / 50.0 AS x, l_extendedprice::DOUBLE / 105000.0 AS y, l_discount::DOUBLE * 10.0 AS z FROM lineitem),
e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS f, max(z) AS g FROM p)
SELECT i::INT AS corner, CASE WHEN i & 1 > 0 THEN b ELSE a END AS x, CASE WHEN i & 2 > 0 THEN d ELSE c END AS y, CASE WHEN i & 4 > 0 THEN g ELSE f END AS z FROM e, range(8) t(i)""")
def corners(spark, d):
    return D.corners(tables.lines(spark, d))


@query(_KEYED + " SELECT gid, base_key, leaf_key FROM src_k")
def point_keys(spark, d):
    return _keyed(spark, d).select("gid", "base_key", "leaf_key")


@query(_KEYED + " SELECT gid, ax, ay, az, 16::INT AS level FROM src_k")
def key_decode(spark, d):
    return _keyed(spark, d).select("gid", *_axes(*M.anchor(F.col("base_key"))), M.level(F.col("base_key")).alias("level"))


@query(_BOXES + f" SELECT {_cell_key()} AS key, CASE WHEN level > 0 THEN {_bits(*[f'(c{c} >> 1) << (17 - level)' for c in 'xyz'], 'level - 1')} END AS parent, level FROM src_b WHERE level > 0")
def key_parent(spark, d):
    up = _leaves(spark, d).select(F.explode(M.ancestors(F.col("key"), 1)).alias("key")).distinct()
    return up.select("key", M.parent(F.col("key")).alias("parent"), M.level(F.col("key")).alias("level"))


@query(_BOXES + f""", kids AS (SELECT level + 1 AS level, 2 * cx + (i >> 2) AS cx, 2 * cy + ((i >> 1) & 1) AS cy, 2 * cz + (i & 1) AS cz, {_cell_key()} AS key, i::INT AS child FROM src_b, range(8) t(i) WHERE level = 2)
SELECT key, child, {_cell_key()} AS child_key FROM kids""")
def key_children(spark, d):
    keys = _keyed(spark, d).select(M.at_level(F.col("base_key"), 2).alias("key")).distinct()
    return keys.select("key", F.posexplode(M.children(F.col("key"))).alias("child", "child_key"))


@query(_KEYED + f""" SELECT key, {_bits(*[f"((c{c} >> 1) * 2 + {bit}) << {16 - DEPTH}" for c, bit in zip("xyz", ("(i >> 2)", "((i >> 1) & 1)", "(i & 1)"), strict=True)], str(DEPTH))} AS sibling FROM src_c, range(8) t(i)""")
def key_siblings(spark, d):
    return _leaves(spark, d).select("key", F.explode(M.siblings(F.col("key"))).alias("sibling"))


@query(_KEYED + f""", l AS (SELECT unnest(range(0, {DEPTH + 1}))::INT AS level) SELECT key, level, {_bits(*[f"(c{c} >> ({DEPTH} - level)) << (16 - level)" for c in "xyz"], "level")} AS ancestor FROM src_c, l""")
def key_ancestors(spark, d):
    up = _leaves(spark, d).select("key", F.explode(M.ancestors(F.col("key"))).alias("ancestor"))
    return up.select("key", M.level(F.col("ancestor")).alias("level"), "ancestor")


@query(_BOXES + f""" SELECT {_cell_key()} AS key, {_bits(*[f"(c{c} * 4 + ((i >> {s}) & 1) * 2 + ((i >> {s - 3 if s > 2 else s}) & 1)) << 12" for c, s in zip("xyz", (5, 4, 3), strict=True)], "4")} AS descendant
FROM src_b, range(64) t(i) WHERE level = 2""")
def key_descendants(spark, d):
    keys = _keyed(spark, d).select(M.at_level(F.col("base_key"), 2).alias("key")).distinct()
    return keys.select("key", F.explode(M.descendants(F.col("key"), 2)).alias("descendant"))


@query(_BOXES + f""" SELECT {_cell_key()} AS key, ({_cell_key()} + 1)::BIGINT AS first_child,
 {_bits(*[f"(c{c} << (16 - level))" for c in "xyz"], "16")} AS finest_first, {_bits(*[f"((c{c} + 1) << (16 - level)) - 1" for c in "xyz"], "16")} AS finest_last FROM src_b WHERE level > 0""")
def key_extremes(spark, d):
    up = _leaves(spark, d).select(F.explode(M.ancestors(F.col("key"), 1)).alias("key")).distinct()
    return up.select("key", M.first_child(F.col("key")).alias("first_child"), M.finest_first_child(F.col("key")).alias("finest_first"), M.finest_last_child(F.col("key")).alias("finest_last"))


_NEAR26 = "(SELECT dx, dy, dz FROM range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz))"
_INSIDE = lambda n: " AND ".join(f"{c} BETWEEN 0 AND {n}" for c in ("nx", "ny", "nz"))


@query(_KEYED + f""", n AS (SELECT key, cx + dx AS nx, cy + dy AS ny, cz + dz AS nz FROM src_c, {_NEAR26} WHERE dx <> 0 OR dy <> 0 OR dz <> 0)
SELECT key, {_bits("nx << 13", "ny << 13", "nz << 13", "3")} AS neighbour FROM n WHERE {_INSIDE(7)}""")
def key_neighbours(spark, d):
    return _leaves(spark, d).select("key", F.explode(M.neighbours(F.col("key"))).alias("neighbour"))


@query(_KEYED + f""" SELECT key, {_bits("(cx + 2) << 13", "cy << 13", "(cz - 1) << 13", "3")} AS moved FROM src_c WHERE cx + 2 <= 7 AND cz >= 1""")
def key_in_direction(spark, d):
    return _leaves(spark, d).select("key", M.in_direction(F.col("key"), 2, 0, -1).alias("moved")).filter("moved is not null")


@query(_KEYED + """, m AS (SELECT a.cx AS ax, a.cy AS ay, a.cz AS az, a.key AS a, b.key AS b, b.cx, b.cy, b.cz FROM tgt_c a, src_c b)
SELECT a, b, abs(ax - cx) <= 1 AND abs(ay - cy) <= 1 AND abs(az - cz) <= 1 AND a <> b AS adjacent, a = b AS ancestor FROM m""")
def key_adjacency(spark, d):
    a, b = _leaves(spark, d, _targets(spark, d)), _leaves(spark, d)
    pairs = a.select(F.col("key").alias("a")).join(F.broadcast(b.select(F.col("key").alias("b"))), F.lit(True))  # at most 8**3 leaves
    return pairs.select("a", "b", M.is_adjacent(F.col("a"), F.col("b")).alias("adjacent"), M.is_ancestor(F.col("a"), F.col("b")).alias("ancestor"))


@query(_KEYED + f""", m AS (SELECT a.key AS a, b.key AS b, a.cx AS ax, a.cy AS ay, a.cz AS az, b.cx AS bx, b.cy AS b_y, b.cz AS bz FROM tgt_c a, src_c b),
l AS (SELECT *, (SELECT max(v) FROM range(0, 4) t(v) WHERE (ax >> (3 - v)::INT) = (bx >> (3 - v)::INT) AND (ay >> (3 - v)::INT) = (b_y >> (3 - v)::INT) AND (az >> (3 - v)::INT) = (bz >> (3 - v)::INT)) AS level FROM m)
SELECT a, b, {_bits(*[f"(a{c} >> (3 - level)) << (16 - level)" for c in "xyz"], "level")} AS common FROM l""")
def key_finest_ancestor(spark, d):
    a, b = _leaves(spark, d, _targets(spark, d)), _leaves(spark, d)
    pairs = a.select(F.col("key").alias("a")).join(F.broadcast(b.select(F.col("key").alias("b"))), F.lit(True))  # at most 8**3 leaves
    return pairs.select("a", "b", M.finest_ancestor(F.col("a"), F.col("b")).alias("common"))


@query(_KEYED + """ SELECT key, round(ox + (cx + 0.5) * side / 8, 9) + 0.0 AS x, round(oy + (cy + 0.5) * side / 8, 9) + 0.0 AS y, round(oz + (cz + 0.5) * side / 8, 9) + 0.0 AS z, round(side / 8, 9) AS diameter FROM src_c, dom""")
def key_centres(spark, d):
    dom = _domain(spark, d)
    c = M.centre(F.col("key"), dom)
    return _round(_leaves(spark, d).select("key", c[0].alias("x"), c[1].alias("y"), c[2].alias("z"), M.diameter(F.col("key"), dom.side).alias("diameter")), "x", "y", "z", "diameter", digits=9)


@query(_KEYED + """ SELECT key, i::INT AS corner, round(ox + (cx + (i & 1)) * side / 8, 9) + 0.0 AS x, round(oy + (cy + ((i >> 1) & 1)) * side / 8, 9) + 0.0 AS y, round(oz + (cz + (i >> 2)) * side / 8, 9) + 0.0 AS z FROM src_c, dom, range(8) t(i)""")
def box_corners(spark, d):
    dom = _domain(spark, d)
    rows = _leaves(spark, d).select("key", M.box_coordinates(F.col("key"), dom).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner"))
    at = [F.element_at("b", (3 * F.col("corner") + i + 1).cast("int")).alias(c) for i, c in enumerate("xyz")]
    return _round(rows.select("key", "corner", *at), "x", "y", "z", digits=9)


_SHELL = "(SELECT i, j, k, (row_number() OVER (ORDER BY k, j, i) - 1)::INT AS point FROM range(4) a(i), range(4) b(j), range(4) c(k) WHERE i IN (0, 3) OR j IN (0, 3) OR k IN (0, 3))"


@query(_KEYED + f""" SELECT key, point, {", ".join(f"round(o{c} + (c{c} + 0.5) * side / 8 + side / 16 * 1.05 * ({i} * 2 / 3.0 - 1), 9) + 0.0 AS {c}" for c, i in zip("xyz", "ijk", strict=True))} FROM src_c, dom, {_SHELL} s""")
def box_surfaces(spark, d):
    """Equivalent surfaces of order 4 of all occupied leaves."""
    return _round(S.box_surfaces(_leaves(spark, d), _domain(spark, d), 4, 1.05), "x", "y", "z", digits=9)


@query(_BOXES + """, g AS (SELECT i, j, k, (row_number() OVER (ORDER BY k, j, i) - 1)::INT AS point FROM range(5) a(i), range(5) b(j), range(5) c(k)),
b AS (SELECT *, """ + _cell_key() + """ AS key FROM src_b WHERE level = 2)
SELECT key, point, """ + ", ".join(f"round(o{c} + (c{c} + 0.5) * side / 4 + side / 4 * 0.525 * ({i} - 3), 9) + 0.0 AS {c}" for c, i in zip("xyz", "ijk", strict=True)) + " FROM b, dom, g")
def convolution_grid(spark, d):
    """The convolution grids of order 3 of all occupied boxes of level 2."""
    dom = _domain(spark, d)
    unit = surfaces.convolution_grid(3, (0.0, 0.0, 0.0), 1.0, 1.05)
    grid = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(row, "xyz", strict=True)]) for row in unit])
    boxes = _keyed(spark, d).select(M.at_level(F.col("base_key"), 2).alias("key")).distinct()
    rows = boxes.select("key", *[c.alias(f"c{n}") for c, n in zip(M.centre(F.col("key"), dom), "xyz", strict=True)], F.posexplode(grid).alias("point", "g"))
    return _round(rows.select("key", "point", *[(F.col(f"c{c}") + F.col("g")[c] * (dom.side / 4)).alias(c) for c in "xyz"]), "x", "y", "z", digits=9)


# ---- trees ------------------------------------------------------------------------------------------------------------


@query(_KEYED + " SELECT leaf_key AS key, count(*) AS n_points FROM src_k GROUP BY ALL")
def leaf_occupancy(spark, d):
    return _keyed(spark, d).groupBy(F.col("leaf_key").alias("key")).agg(F.count(F.lit(1)).alias("n_points"))


_FAMILY = f"""{_BOXES}, kin AS (SELECT DISTINCT level, (cx >> 1) * 2 + (i >> 2) AS cx, (cy >> 1) * 2 + ((i >> 1) & 1) AS cy, (cz >> 1) * 2 + (i & 1) AS cz FROM src_b, range(8) t(i) WHERE level > 0
  UNION SELECT 0, 0, 0, 0)"""


@query(f"""{_FAMILY}, k AS (SELECT {_cell_key()} AS key, level FROM kin), n AS (SELECT leaf_key AS key, count(*) AS n_points FROM src_k GROUP BY ALL)
SELECT key, level, level = {DEPTH} AS is_leaf, coalesce(n_points, 0) AS n_points FROM k LEFT JOIN n USING (key)""")
def tree_pruned(spark, d):
    return T.build(_points(spark, d), DEPTH, True, _domain(spark, d)).boxes.select("key", "level", "is_leaf", "n_points")


@query(f"""{_KEYED}, k AS (SELECT level::INT AS level, i FROM range(0, {DEPTH + 1}) a(level), LATERAL (SELECT unnest(range(0, 8 ** level::INT)) AS i)),
n AS (SELECT leaf_key AS key, count(*) AS n_points FROM src_k GROUP BY ALL),
m AS (SELECT level, ((i << (3 * (16 - level))) << 15) + level AS key FROM k)
SELECT key::BIGINT AS key, level, level = {DEPTH} AS is_leaf, coalesce(n_points, 0) AS n_points FROM m LEFT JOIN n USING (key)""".replace("8 ** level::INT", "(8 ** level)::BIGINT"))
def tree_complete(spark, d):
    return T.build(_points(spark, d), DEPTH, False, _domain(spark, d)).boxes.select("key", "level", "is_leaf", "n_points")


@query(f"""{_FAMILY} SELECT level, count(*) AS n_keys FROM kin GROUP BY ALL""")
def tree_level_counts(spark, d):
    return T.build(_points(spark, d), DEPTH, True, _domain(spark, d)).boxes.groupBy("level").agg(F.count(F.lit(1)).alias("n_keys"))


@query(f"""{_FAMILY}, k AS (SELECT {_cell_key()} AS key, level FROM kin)
SELECT key, row_number() OVER (ORDER BY level, key) - 1 AS "index", row_number() OVER (PARTITION BY level ORDER BY key) - 1 AS level_index,
  CASE WHEN level = {DEPTH} THEN row_number() OVER (PARTITION BY level = {DEPTH} ORDER BY key) - 1 ELSE -1 END AS leaf_index FROM k""")
def tree_index(spark, d):
    made = T.build(_points(spark, d), DEPTH, True, _domain(spark, d)).indexed()
    return made.select("key", *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("index", "level_index", "leaf_index")])


@query(_KEYED + f""", r AS (SELECT min({_bits(*[_at(a, 1) for a in ("ax", "ay", "az")], "1")}) AS root FROM src_k)
SELECT leaf_key AS key, count(*) AS n_points FROM src_k, r WHERE {_bits(*[_at(a, 1) for a in ("ax", "ay", "az")], "1")} = root GROUP BY ALL""")
def tree_with_root(spark, d):
    root = _keyed(spark, d).agg(F.min(M.at_level(F.col("base_key"), 1))).first()[0]
    return T.build(_points(spark, d), DEPTH, True, _domain(spark, d), root).boxes.filter("n_points > 0").select("key", "n_points")


@query(_KEYED + f""" SELECT {_bits(*[_at(a, 1) for a in ("ax", "ay", "az")], "1")} AS root, leaf_key AS leaf, count(*) AS n_points FROM src_k GROUP BY ALL""")
def tree_from_roots(spark, d):
    roots = _keyed(spark, d).select(M.at_level(F.col("base_key"), 1).alias("key")).distinct()
    return T.from_roots(_points(spark, d), roots, DEPTH, _domain(spark, d))


@query(_KEYED + " SELECT gid, row_number() OVER (ORDER BY leaf_key, gid) AS rank FROM src_k")
def tree_order(spark, d):
    return T.build(_points(spark, d), DEPTH, True, _domain(spark, d)).global_indices()


def _min_depth_sql() -> str:
    return "WITH RECURSIVE n AS (SELECT count(*) AS n, 0 AS depth FROM embeddings UNION ALL SELECT n // 8, depth + 1 FROM n WHERE n > 10) SELECT max(depth)::INT AS depth FROM n"


@query(_min_depth_sql())
def minimum_depth(spark, d):
    return spark.createDataFrame([(K.minimum_depth(_points(spark, d).count(), 10),)], "depth int")


@query(f"""{_KEYED}, mixed AS (SELECT DISTINCT {_bits("cx << 13", "cy << 13", "cz << 13", "3")} AS key FROM src_c WHERE cx < 4
  UNION SELECT DISTINCT {_bits("(cx >> 1) << 14", "(cy >> 1) << 14", "(cz >> 1) << 14", "2")} FROM src_c)
SELECT key FROM mixed a WHERE (key & 32767) = 3 OR NOT EXISTS (SELECT 1 FROM mixed b WHERE (b.key & 32767) = 3 AND b.key >> 57 = a.key >> 57)""")
def keys_linearized(spark, d):
    fine = _leaves(spark, d)
    low = fine.filter(M.anchor(F.col("key"))[0] < (4 << 13))
    mixed = low.union(fine.select(M.at_level(F.col("key"), 2).alias("key")))
    return K.linearize(mixed)


@query(_KEYED + f""", l2 AS (SELECT DISTINCT {_bits(*[_at(a, 2) for a in ("ax", "ay", "az")], "2")} AS key FROM src_k WHERE ax < 32768),
l1 AS (SELECT DISTINCT {_bits(*[_at(a, 1) for a in ("ax", "ay", "az")], "1")} AS key FROM src_k WHERE az < 32768),
p AS (SELECT gid, {_bits(*[_at(a, 2) for a in ("ax", "ay", "az")], "2")} AS k2, {_bits(*[_at(a, 1) for a in ("ax", "ay", "az")], "1")} AS k1 FROM src_k)
SELECT gid, CASE WHEN k2 IN (SELECT key FROM l2) THEN k2 ELSE k1 END AS box FROM p WHERE k2 IN (SELECT key FROM l2) OR k1 IN (SELECT key FROM l1)""")
def points_assigned(spark, d):
    placed = _keyed(spark, d).select("gid", "base_key")
    ax, _, az = M.anchor(F.col("base_key"))
    boxes = placed.filter(ax < 32768).select(M.at_level(F.col("base_key"), 2).alias("key")).union(placed.filter(az < 32768).select(M.at_level(F.col("base_key"), 1).alias("key"))).distinct()
    return K.assign(placed, boxes).select("gid", "box")


@query(_KEYED + f""", b AS (SELECT DISTINCT {_bits(*[_at(a, 2) for a in ("ax", "ay", "az")], "2")} AS box, gid FROM src_k)
SELECT box, count(*) AS n, min(gid) AS first_gid, sum(gid)::BIGINT AS gids FROM b GROUP BY ALL""")
def points_by_box(spark, d):
    placed = _keyed(spark, d).select("gid", "base_key")
    made = K.index_map(placed, placed.select(M.at_level(F.col("base_key"), 2).alias("key")).distinct())
    return made.select("box", F.size("gids").cast("long").alias("n"), F.element_at("gids", 1).alias("first_gid"), F.aggregate("gids", F.lit(0).cast("long"), lambda a, x: a + x).alias("gids"))


@query(_KEYED + f""", all2 AS (SELECT ((i << 42) << 15) + 2 AS key FROM range(64) t(i)), full2 AS (SELECT DISTINCT {_bits(*[_at(a, 2) for a in ("ax", "ay", "az")], "2")} AS key FROM src_k)
SELECT key::BIGINT AS key FROM all2 WHERE key NOT IN (SELECT key FROM full2)""")
def boxes_empty(spark, d):
    boxes = spark.range(64).select(F.shiftleft("id", 57).bitwiseOR(F.lit(2).cast("long")).alias("key"))
    return K.empty_boxes(_keyed(spark, d).select("gid", "base_key"), boxes)


def _split_sql(n_crit: int, points: str = "src_k") -> str:
    """CTEs: ``parts``, the points of the boxes on the way down with the points of their box, and ``fine``, the boxes that are left."""
    cell = lambda c, shift: f"a{c} >> (16 - {shift})"
    return f"""{_KEYED.replace("WITH", "WITH RECURSIVE", 1)},
parts AS (SELECT ax, ay, az, 0::INT AS level, count(*) OVER () AS n FROM {points}
  UNION ALL SELECT ax, ay, az, level + 1, count(*) OVER (PARTITION BY {", ".join(cell(c, "(level + 1)") for c in "xyz")}) FROM parts WHERE n > {n_crit} AND level < 16),
over AS (SELECT DISTINCT level, {", ".join(f"{cell(c, 'level')} AS c{c}" for c in "xyz")} FROM parts WHERE n > {n_crit} AND level < 16),
fine AS (SELECT level + 1 AS level, 2 * cx + (i >> 2) AS cx, 2 * cy + ((i >> 1) & 1) AS cy, 2 * cz + (i & 1) AS cz FROM over, range(8) t(i) EXCEPT SELECT * FROM over
  UNION ALL SELECT 0, 0, 0, 0 WHERE NOT EXISTS (SELECT 1 FROM over))"""


@query(_split_sql(40) + f" SELECT {_cell_key()} AS key FROM fine")
def blocks_split(spark, d):
    """Leaves of at most 40 points from the root down, at any depth."""
    placed = _keyed(spark, d).select("gid", "base_key")
    return K.split_blocks(placed, spark.range(1).select(F.lit(0).cast("long").alias("key")), 40)


@query(_BOXES + f", m AS (SELECT * FROM src_b WHERE level = 3 AND cx < 4 UNION SELECT * FROM src_b WHERE level = 2) SELECT {_cell_key()} AS key FROM m WHERE level = (SELECT min(level) FROM m)")
def seeds(spark, d):
    fine = _leaves(spark, d)
    return K.find_seeds(fine.filter(M.anchor(F.col("key"))[0] < (4 << 13)).union(fine.select(M.at_level(F.col("key"), 2).alias("key")).distinct()))


#: A box brings in the parents of its neighbours with their siblings, level by level; boxes above others then go.
def _balanced_sql(n_crit: int, points: str = "src_k") -> str:
    """CTE ``leaves``: the balanced leaves as cells."""
    return f"""{_split_sql(n_crit, points)},
closed AS (SELECT level, cx::INT AS cx, cy::INT AS cy, cz::INT AS cz FROM fine
  UNION SELECT level - 1, (((cx + dx) >> 2) * 2 + (i >> 2))::INT, (((cy + dy) >> 2) * 2 + ((i >> 1) & 1))::INT, (((cz + dz) >> 2) * 2 + (i & 1))::INT
  FROM closed, range(-1, 2) u(dx), range(-1, 2) v(dy), range(-1, 2) w(dz), range(8) t(i)
  WHERE level > 1 AND cx + dx BETWEEN 0 AND (1 << level) - 1 AND cy + dy BETWEEN 0 AND (1 << level) - 1 AND cz + dz BETWEEN 0 AND (1 << level) - 1),
above AS (SELECT level - l AS level, cx >> l AS cx, cy >> l AS cy, cz >> l AS cz FROM closed, range(1, 17) t(l) WHERE l <= level),
leaves AS (SELECT level, cx, cy, cz FROM closed EXCEPT SELECT * FROM above)"""


_BALANCED = f"{_balanced_sql(10)} SELECT {_cell_key()} AS key FROM leaves"


@query(_BALANCED)
def keys_balanced(spark, d):
    """2:1 balance of leaves split to at most 10 points."""
    placed = _keyed(spark, d).select("gid", "base_key")
    return K.balance(K.split_blocks(placed, spark.range(1).select(F.lit(0).cast("long").alias("key")), 10))


@query(f"""{_KEYED}, ends AS (SELECT min(key) AS lo, max(key) AS hi FROM src_c),
boxes AS (SELECT l::INT AS level, cx, cy, cz FROM range(1, {DEPTH + 1}) a(l), range({2**DEPTH}) x(cx), range({2**DEPTH}) y(cy), range({2**DEPTH}) z(cz) WHERE greatest(cx, cy, cz) < 1 << l),
held AS (SELECT level, cx >> ({DEPTH} - level) AS cx, cy >> ({DEPTH} - level) AS cy, cz >> ({DEPTH} - level) AS cz FROM src_c, range(0, {DEPTH + 1}) t(level)),
free AS (SELECT *, {_cell_key()} AS key FROM (SELECT * FROM boxes EXCEPT SELECT level, cx, cy, cz FROM held)),
gaps AS (SELECT f.* FROM free f, ends WHERE key > lo AND key < hi)
SELECT key FROM src_c UNION SELECT key FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM gaps p WHERE p.level = g.level - 1 AND p.cx = g.cx >> 1 AND p.cy = g.cy >> 1 AND p.cz = g.cz >> 1)""")
def keys_completed(spark, d):
    """Occupied leaves and the fewest boxes between them."""
    return K.complete(_leaves(spark, d))


@query(_KEYED + """, b AS (SELECT min(key) AS lo, max(key) AS hi FROM src_c), s AS (SELECT key FROM src_c, b WHERE key IN (lo, hi))
SELECT 1.0::DOUBLE AS volume, count(*)::BIGINT AS seeds FROM s""")
def block_tree(spark, d):
    """A tree from the first and last occupied leaf covers the whole domain once, and holds both."""
    ends = _leaves(spark, d).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).select(F.explode(F.array("lo", "hi")).alias("key")).distinct()
    made = K.complete_block_tree(ends)
    held = made.join(ends.withColumn("seed", F.lit(1)), "key", "left")
    return held.agg(F.sum(F.pow(F.lit(8.0), -M.level(F.col("key")))).alias("volume"), F.sum(F.coalesce("seed", F.lit(0))).cast("long").alias("seeds"))


# ---- interaction lists ---------------------------------------------------------------------------------------------------

_TV = "CASE WHEN {0} < 0 THEN 2 * abs({0}) + 1 ELSE 2 * {0} END"


def _tv(dx: str, dy: str, dz: str) -> str:
    return f"(({_TV.format(dx)})::BIGINT << 32) + (({_TV.format(dy)})::BIGINT << 16) + ({_TV.format(dz)})"


@query(f"""{_BOXES}, r AS (SELECT dx::INT AS dx, dy::INT AS dy, dz::INT AS dz FROM range(-3, 4) a(dx), range(-3, 4) b(dy), range(-3, 4) c(dz) WHERE greatest(abs(dx), abs(dy), abs(dz)) >= 2),
v AS (SELECT s.cx - t.cx AS dx, s.cy - t.cy AS dy, s.cz - t.cz AS dz, count(*) AS pairs FROM tgt_b t JOIN src_b s ON t.level = s.level AND t.level >= 2
  AND abs((t.cx >> 1) - (s.cx >> 1)) <= 1 AND abs((t.cy >> 1) - (s.cy >> 1)) <= 1 AND abs((t.cz >> 1) - (s.cz >> 1)) <= 1 GROUP BY ALL)
SELECT ({_tv("dx", "dy", "dz")})::BIGINT AS hash, dx, dy, dz, coalesce(pairs, 0) AS pairs FROM r LEFT JOIN v USING (dx, dy, dz)""")
def transfer_vectors(spark, d):
    """The unique far-field offsets, and how many pairs of occupied boxes have each."""
    above = lambda p: _leaves(spark, d, p).select(F.explode(M.ancestors(F.col("key"), 2)).alias("key")).distinct()
    pairs = I.v_list(above(_targets(spark, d)), above(None)).groupBy(F.col("tv").alias("hash")).agg(F.count(F.lit(1)).alias("pairs"))
    return K.transfer_vectors(spark).select("hash", "dx", "dy", "dz").join(pairs, "hash", "left").fillna(0, ["pairs"])


@query(_KEYED + " SELECT t.key AS target, s.key AS source FROM tgt_c t JOIN src_c s ON abs(t.cx - s.cx) <= 1 AND abs(t.cy - s.cy) <= 1 AND abs(t.cz - s.cz) <= 1")
def u_list(spark, d):
    return I.u_list(_leaves(spark, d, _targets(spark, d)), _leaves(spark, d))


#: Points of both sets to a leaf of the adaptive queries.
N_CRIT = 20
_INSIDE_LEAF = " AND ".join(f"(p.a{c} >> (16 - l.level)) = l.c{c}" for c in "xyz")
#: Corners of boxes in units of the deepest level, and whether two of them touch.
_SPAN = lambda b: {c: (f"({b}.c{c}::BIGINT << (16 - {b}.level))", f"(({b}.c{c}::BIGINT + 1) << (16 - {b}.level))") for c in "xyz"}
_TOUCH = lambda a, b: "(" + " AND ".join(f"{_SPAN(a)[c][0]} <= {_SPAN(b)[c][1]} AND {_SPAN(b)[c][0]} <= {_SPAN(a)[c][1]}" for c in "xyz") + ")"
_UP = "SELECT DISTINCT level - l AS level, cx >> l AS cx, cy >> l AS cy, cz >> l AS cz FROM {}, range(0, 17) t(l) WHERE l <= level"
_ADAPTIVE = f"""{_balanced_sql(N_CRIT, "(SELECT ax, ay, az FROM src_k UNION ALL SELECT ax, ay, az FROM tgt_k)")},
src_l AS (SELECT l.level, cx, cy, cz, count(*) AS n FROM leaves l JOIN src_k p ON {_INSIDE_LEAF} GROUP BY ALL),
tgt_l AS (SELECT l.level, cx, cy, cz, count(*) AS n FROM leaves l JOIN tgt_k p ON {_INSIDE_LEAF} GROUP BY ALL),
src_u AS ({_UP.format("src_l")}), tgt_u AS ({_UP.format("tgt_l")}),
src_p AS (SELECT *, level - 1 AS plevel, cx >> 1 AS px, cy >> 1 AS py, cz >> 1 AS pz FROM src_u WHERE level > 0),
tgt_p AS (SELECT *, level - 1 AS plevel, cx >> 1 AS px, cy >> 1 AS py, cz >> 1 AS pz FROM tgt_u WHERE level > 0)"""
_FINER = lambda leaf, box: f"{box}.level > {leaf}.level AND NOT {_TOUCH(leaf, box)} AND {_TOUCH(leaf, 'PARENT')}".replace("PARENT.level", f"{box}.plevel").replace("PARENT.c", f"{box}.p")


def _adaptive(spark: SparkSession, d: str) -> tuple:
    """Source and target trees over balanced leaves of at most ``N_CRIT`` points of both sets."""
    return A.build(_points(spark, d), _targets(spark, d), N_CRIT, _domain(spark, d))


def _leaf_keys(tree) -> DataFrame:
    return tree.boxes.filter("is_leaf").select("key")


@query(_ADAPTIVE + f""" SELECT {_cell_key()} AS key, level, coalesce(s.n, 0) AS n_sources, coalesce(t.n, 0) AS n_targets FROM src_l s FULL JOIN tgt_l t USING (level, cx, cy, cz)""")
def adaptive_leaves(spark, d):
    """Occupied leaves of the balanced tree of both sets."""
    s, t = (tree.boxes.filter("is_leaf").select("key", "level", F.col("n_points").alias(f"n_{name}s")) for tree, name in zip(_adaptive(spark, d), ("source", "target"), strict=True))
    return s.join(t, ["key", "level"], "full").fillna(0)


@query(_ADAPTIVE + f""" SELECT {_cell_key("t.")} AS target, {_cell_key("s.")} AS source FROM tgt_l t JOIN src_l s ON {_TOUCH("t", "s")}""")
def adaptive_u_list(spark, d):
    s, t = _adaptive(spark, d)
    return I.mixed_u_list(_leaf_keys(t), _leaf_keys(s))


@query(_ADAPTIVE + f""" SELECT {_cell_key("t.")} AS leaf, {_cell_key("s.")} AS box FROM tgt_l t JOIN src_p s ON {_FINER("t", "s")}""")
def adaptive_w_list(spark, d):
    s, t = _adaptive(spark, d)
    return I.w_list(_leaf_keys(t), s.boxes.select("key"))


@query(_ADAPTIVE + f""" SELECT {_cell_key("t.")} AS target, {_cell_key("s.")} AS source FROM tgt_p t JOIN src_l s ON {_FINER("s", "t")}""")
def adaptive_x_list(spark, d):
    s, t = _adaptive(spark, d)
    return I.x_list(t.boxes.select("key"), _leaf_keys(s))


@query(f"""{_BOXES} SELECT t.level, {_cell_key("t.")} AS target, {_cell_key("s.")} AS source, ({_tv("(s.cx - t.cx)", "(s.cy - t.cy)", "(s.cz - t.cz)")})::BIGINT AS tv
FROM tgt_b t JOIN src_b s ON t.level = s.level AND t.level >= 2 AND abs((t.cx >> 1) - (s.cx >> 1)) <= 1 AND abs((t.cy >> 1) - (s.cy >> 1)) <= 1 AND abs((t.cz >> 1) - (s.cz >> 1)) <= 1
  AND greatest(abs(t.cx - s.cx), abs(t.cy - s.cy), abs(t.cz - s.cz)) >= 2""")
def v_list(spark, d):
    above = lambda p: _leaves(spark, d, p).select(F.explode(M.ancestors(F.col("key"), 2)).alias("key")).distinct()
    return I.v_list(above(_targets(spark, d)), above(None))


@query(f"""{_BOXES} SELECT {_bits(*[f"(c{c} >> 1) << (17 - level)" for c in "xyz"], "level - 1")} AS parent, {_cell_key()} AS child FROM src_b WHERE level > 0""")
def box_family(spark, d):
    boxes = T.build(_points(spark, d), DEPTH, True, _domain(spark, d)).boxes
    occupied = _leaves(spark, d).select(F.explode(M.ancestors(F.col("key"))).alias("key")).distinct()
    return I.family(boxes.join(occupied, "key", "left_semi"))


_NEAR_SQL = _KEYED + """, near AS (SELECT t.gid, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz, s.q FROM tgt_k t JOIN src_k s
  ON abs((t.ax >> 13) - (s.ax >> 13)) <= 1 AND abs((t.ay >> 13) - (s.ay >> 13)) <= 1 AND abs((t.az >> 13) - (s.az >> 13)) <= 1),
r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM near)
SELECT gid, 0::INT AS vec_idx, {} FROM r GROUP BY gid"""


@query(_NEAR_SQL.format(f"round(sum({_LAPLACE['phi']}), 6) + 0.0 AS phi"))
def near_field_laplace(spark, d):
    return _round(I.near_field(_keyed(spark, d, _targets(spark, d)), _keyed(spark, d), _charges(_points(spark, d)), Laplace()), "phi")


@query(_NEAR_SQL.format(", ".join(f"round(sum({t}), 4) + 0.0 AS {n}" for n, t in _LAPLACE.items())))
def near_field_gradient(spark, d):
    return _round(I.near_field(_keyed(spark, d, _targets(spark, d)), _keyed(spark, d), _charges(_points(spark, d)), Laplace(), True), "phi", "gx", "gy", "gz", digits=4)


@query(_NEAR_SQL.format(", ".join(f"round(sum({t}), 6) + 0.0 AS {n}" for n, t in _HELMHOLTZ.items())))
def near_field_helmholtz(spark, d):
    return _round(I.near_field(_keyed(spark, d, _targets(spark, d)), _keyed(spark, d), _charges(_points(spark, d)), Helmholtz(WAVENUMBER)), "phi", "phi_im")


@query(_KEYED + f""", p AS (SELECT t.gid, s.q, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz,
  abs((t.ax >> 13) - (s.ax >> 13)) <= 1 AND abs((t.ay >> 13) - (s.ay >> 13)) <= 1 AND abs((t.az >> 13) - (s.az >> 13)) <= 1 AS near FROM tgt_k t, src_k s),
r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM p),
s AS (SELECT gid, sum({_LAPLACE["phi"]}) AS e, coalesce(sum({_LAPLACE["phi"]}) FILTER (WHERE near), 0) AS f FROM r GROUP BY gid)
SELECT round(sqrt(sum((f - e) ** 2) / sum(e ** 2)), 8) AS l2_error FROM s""")
def near_field_error(spark, d):
    """What the near field alone misses of the exact sum."""
    s, t = _points(spark, d), _targets(spark, d)
    exact = I.direct(t, s, _charges(s), Laplace())
    near = I.near_field(_keyed(spark, d, t), _keyed(spark, d), _charges(s), Laplace())
    found = exact.select("gid", "vec_idx").join(near, ["gid", "vec_idx"], "left").fillna(0.0, ["phi"])
    return _round(I.l2_error(found, exact), "l2_error", digits=8)


# ---- sources, layouts and searches -----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT count(*) AS n FROM embeddings) SELECT unnest(['column', 'sphere', 'spheroid', 'uniform', 'uniform box']) AS name, n, n AS different, true AS inside FROM e""")
def point_sets(spark, d):
    """As many points of the seeded generators as there are embeddings, one set over their domain: how many, different ones, and whether all
    lie where they should."""
    c, between = F.col, lambda name, low, high: (F.col(name) >= low) & (F.col(name) < high)
    on = lambda a, b: F.abs((c("x") ** 2 + c("y") ** 2) / a**2 + c("z") ** 2 / b**2 - 1) < 1e-12
    every = lambda low, high: between("x", low, high) & between("y", low, high) & between("z", low, high)
    points, dom = _points(spark, d), _domain(spark, d)
    n, low = points.count(), min(dom.origin)
    sets = {
        "uniform": (fixtures.uniform(spark, n, seed=1), every(0, 1)),
        "uniform box": (fixtures.uniform(spark, n, low, low + dom.side, seed=2), every(low, low + dom.side)),
        "column": (fixtures.column(spark, n), between("x", 0, 0.1) & between("y", 0, 0.1) & between("z", 0, 500)),
        "sphere": (fixtures.sphere(spark, n), on(1, 1)),
        "spheroid": (fixtures.spheroid(spark, n, 2.0, 0.5), on(2.0, 0.5)),
    }
    found = None
    for name, (points, inside) in sets.items():
        row = points.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x", "y", "z").alias("different"), F.every(inside).alias("inside")).select(F.lit(name).alias("name"), "n", "different", "inside")
        found = row if found is None else found.union(row)
    return found


@query("""WITH v AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
f AS (SELECT a.i % 4 AS mesh, a.i AS face, unnest([a.i, b.i, c.i]) AS i FROM v a JOIN v b ON b.i = a.i + 1 JOIN v c ON c.i = a.i + 2)
SELECT mesh::INT AS mesh, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, count(*) AS faces FROM f JOIN v USING (i) GROUP BY ALL""")
def stl_vertices(spark, d):
    """Four meshes written as text, their triangles three points with ids in a row; read back: vertices and how many triangles have each."""
    at = _points(spark, d).select(F.col("gid").alias("i"), F.concat_ws(" ", F.lit("vertex"), "x", "y", "z").alias("said"))
    second, third = (at.select((F.col("i") - k).alias("i"), F.col("said").alias(f"said{k}")) for k in (1, 2))
    faces = at.join(second, "i").join(third, "i").select((F.col("i") % 4).alias("mesh"), F.concat_ws(" ", F.lit("facet"), "said", "said1", "said2", F.lit("endfacet")).alias("value"))
    path = f"{shared_dir(spark)}/meshes-{uuid.uuid4().hex}"
    faces.repartition("mesh").write.partitionBy("mesh").text(path)
    found = stl.read_stl(spark, f"{path}/mesh=*")
    return _round(found.select(F.regexp_extract("path", "mesh=(\\d+)", 1).cast("int").alias("mesh"), "x", "y", "z", F.size("faces").cast("long").alias("faces")), "x", "y", "z")


@query(f"{_FAMILY} SELECT {_cell_key()} AS key, level, level = {DEPTH} AS is_leaf FROM kin")
def tree_from_leaves(spark, d):
    return T.from_leaves(_leaves(spark, d), DEPTH).boxes.select("key", "level", "is_leaf")


@query("SELECT unnest(['samplesort', 'hyksort', 'simplesort']) AS sort, count(*) AS n, true AS within, true AS apart FROM embeddings")
def sorted_layouts(spark, d):
    """Points laid out by each sort: all there, in order within partitions, and no leaf (box of level 1) in two ranges out of order."""
    tree = T.build(_points(spark, d), DEPTH, True, _domain(spark, d))
    found = None
    for sort in T.SORTS:
        placed = T.partitioned(tree, sort, parts=5).points.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "leaf_key", "gid")
        placed = stored(placed, "sorted-layout")
        before = F.lag(F.struct("leaf_key", "gid")).over(Window.partitionBy("part").orderBy("at"))
        rows = placed.withColumn("right", F.coalesce(before < F.struct("leaf_key", "gid"), F.lit(True)))
        parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.every("right").alias("right"), F.min(F.struct("leaf_key", "gid")).alias("low"), F.max(F.struct("leaf_key", "gid")).alias("high"))
        parts = parts.withColumn("apart", F.coalesce(F.lag("high").over(Window.orderBy("part")) < F.col("low"), F.lit(True)))  # a row for each partition
        if sort == "simplesort":  # boxes of level 1 are whole, in any order of partitions
            box = placed.groupBy(M.at_level(F.col("leaf_key"), 1)).agg(F.count_distinct("part").alias("parts")).agg((F.max("parts") == 1).alias("whole"))
            parts = parts.drop("apart").crossJoin(F.broadcast(box.withColumnRenamed("whole", "apart")))
        row = parts.agg(F.sum("n").alias("n"), F.every("right").alias("within"), F.every("apart").alias("apart")).select(F.lit(sort).alias("sort"), "n", "within", "apart")
        found = row if found is None else found.union(row)
    return found


@query(_KEYED + " SELECT gid, row_number() OVER (ORDER BY leaf_key, gid) * 0.5 AS q FROM src_k")
def charges_by_rank(spark, d):
    """Charges given by rank in tree order, by point."""
    tree = T.build(_points(spark, d), DEPTH, True, _domain(spark, d))
    ranked = spark.range(1, _points(spark, d).count() + 1).select(F.col("id").alias("rank"), (F.col("id") * 0.5).alias("q"))
    return ranked.join(tree.global_indices(), "rank").select("gid", "q")


@query("SELECT 4::INT AS \"order\", 2::INT AS depth, true AS close, true AS timed")
def grid_search(spark, d):
    """Settings of a plan tried against the direct sum: order, depth, whether the error is below 1e-3."""
    s = _points(spark, d)
    found = search.grid_search(spark, s, _targets(spark, d), _charges(s), Laplace(), (4,), (2,), (X.Aca(1e-6),))
    return found.select("order", "depth", (F.col("l2_error") < 1e-3).alias("close"), (F.col("seconds") > 0).alias("timed"))


@query(_direct_sql({"phi": _LAPLACE["phi"]}))
def potentials(spark, d):
    """The sum by the way that suits its size: these sets are below the bound of the direct sum."""
    s, t = _points(spark, d), _targets(spark, d)
    return _round(search.potentials(spark, s, t, _charges(s), Laplace()).select("gid", "vec_idx", "phi"), "phi")


# ---- fast sums: their SQL is that of direct sums; tests hold the rest against these ------------------------------------------------------


def _fast(spark, d, order=6, kernel=None, eval_type="Value", m2l=None, depth=DEPTH, n_vecs=1, **settings):
    s, t = _points(spark, d), _targets(spark, d)
    charges = s.select("gid", F.explode(F.sequence(F.lit(0), F.lit(n_vecs - 1))).alias("vec_idx"), "q")
    return Builder(spark).tree(s, t, depth=depth).parameters(charges, order, kernel or Laplace(), eval_type, m2l, **settings).build()


def _fmm(name: str, **settings):
    def run(spark, d):
        return _fast(spark, d, **settings).evaluate()

    run.__name__ = name
    query()(run)


_fmm("fmm_laplace_fft", m2l=X.Fft())
_fmm("fmm_laplace_sarcmp", m2l=X.SaRcmp(1e-7), order=5)
_fmm("fmm_laplace_aca", m2l=X.Aca(1e-8), order=5)
_fmm("fmm_laplace_gradient", m2l=X.Fft(), eval_type="ValueDeriv")
_fmm("fmm_laplace_many_vectors", m2l=X.Aca(1e-8, surface_diff=1), order=5, n_vecs=2)
_fmm("fmm_laplace_variable_order", m2l=X.Fft(), order=[5, 6, 5, 6])
_fmm("fmm_helmholtz_fft", m2l=X.Fft(), order=5, kernel=Helmholtz(WAVENUMBER))
_fmm("fmm_helmholtz_aca", m2l=X.Aca(1e-8), order=4, kernel=Helmholtz(WAVENUMBER))
_fmm("fmm_helmholtz_ia", m2l=X.Ia(1e-7), order=4, kernel=Helmholtz(WAVENUMBER), depth=2)


def _agrees(fast: DataFrame, exact: DataFrame, tolerance: float) -> DataFrame:
    """gid, vec_idx, agrees: whether a potential differs by at most ``tolerance`` of the root mean square of all."""
    e = exact.select("gid", "vec_idx", F.col("phi").alias("exact"))
    scale = e.agg(F.sqrt(F.avg(F.col("exact") * F.col("exact"))).alias("scale"))  # one row
    return fast.join(e, ["gid", "vec_idx"]).crossJoin(F.broadcast(scale)).select("gid", "vec_idx", (F.abs(F.col("phi") - F.col("exact")) <= tolerance * F.col("scale")).alias("agrees"))


@query("SELECT vec_id AS gid, 0::INT AS vec_idx, true AS agrees FROM embeddings")
def fmm_laplace_agrees(spark, d):
    """Fast potentials of order 6 against the direct sum, each within 1e-5 of the root mean square."""
    s, t = _points(spark, d), _targets(spark, d)
    return _agrees(_fast(spark, d, order=6).evaluate(), I.direct(t, s, schemas.charges(_charges(s)), Laplace()), 1e-5)


@query("SELECT vec_id AS gid, 0::INT AS vec_idx, true AS agrees FROM embeddings")
def fmm_helmholtz_agrees(spark, d):
    """Fast Helmholtz potentials of order 6 against the direct sum, each within 1e-5 of the root mean square."""
    s, t = _points(spark, d), _targets(spark, d)
    kernel = Helmholtz(WAVENUMBER)
    return _agrees(_fast(spark, d, order=6, kernel=kernel).evaluate(), I.direct(t, s, schemas.charges(_charges(s)), kernel), 1e-5)


@query()
def fmm_multipoles(spark, d):
    return _fast(spark, d, order=4).multipoles()


@query()
def fmm_locals(spark, d):
    return _fast(spark, d, order=4).locals()


@query()
def fmm_new_charges(spark, d):
    """A plan evaluated again with charges three times as large."""
    plan = _fast(spark, d, order=4)
    return plan.attach_charges_unordered(_points(spark, d).select("gid", (F.col("q") * 3).alias("q"))).evaluate()


#: Decimals of values of 100 to 1000 that expansions of order 7 and 8 settle (their errors are about 1e-5).
VALUES = 1


def _values_sql(terms: dict[str, str], charges: str = "s.q") -> str:
    return _direct_sql(terms, charges).replace(", 6)", f", {VALUES})")


def _rounded(found: DataFrame) -> DataFrame:
    return _round(found, *[c for c in found.columns if c not in ("gid", "vec_idx")], digits=VALUES)


@query(_values_sql({"phi": _LAPLACE["phi"]}))
def fmm_laplace_values(spark, d):
    """Potentials of order 8 by Fourier far fields."""
    return _rounded(_fast(spark, d, order=8).evaluate())


@query(_values_sql({"phi": _LAPLACE["phi"]}))
def fmm_adaptive_values(spark, d):
    """The same over a balanced adaptive tree, with points to locals and multipoles to points."""
    s = _points(spark, d)
    plan = AdaptiveBuilder(spark).tree(s, _targets(spark, d), N_CRIT).parameters(_charges(s), 8, Laplace()).build()
    return _rounded(plan.evaluate())


@query(_values_sql({"phi": _LAPLACE["phi"]}))
def fmm_sarcmp_values(spark, d):
    """Far fields in one basis by randomised SVDs of the stacked matrices."""
    return _rounded(_fast(spark, d, order=8, m2l=X.SaRcmp(1e-12, svd=X.RandomSvd(250)), depth=2).evaluate())


@query(_values_sql({"phi": _LAPLACE["phi"]}))
def fmm_aca_values(spark, d):
    """Far fields and pseudo-inverses by cross approximation, whose matrices are never formed."""
    return _rounded(_fast(spark, d, order=8, m2l=X.Aca(1e-11), depth=2, pinv=X.Pinv(aca=True)).evaluate())


@query(_BOXES + f""", b AS (SELECT level, {", ".join(f"a{c} >> (16 - level) AS c{c}" for c in "xyz")}, q FROM src_a, levels)
SELECT {_cell_key()} AS key, level, 0::INT AS vec_idx, round(sum(q), 3) + 0.0 AS q FROM b GROUP BY ALL""")
def fmm_box_charges(spark, d):
    """What each multipole expansion holds in all: the charge of its box, whatever went up level by level."""
    found = _fast(spark, d, order=8).multipoles()
    return _round(found.select("key", "level", "vec_idx", F.aggregate("coeff", F.lit(0.0), lambda a, x: a + x).alias("q")), "q", digits=3)


@query(_BOXES + f""", far AS (SELECT {_cell_key("t.")} AS key, t.level, s.q, {", ".join(f"o{c} + (t.c{c} + 0.5) * side / (1 << t.level) - s.{c} AS d{c}" for c in "xyz")}
  FROM tgt_b t, src_a s, dom WHERE t.level >= 2 AND greatest({", ".join(f"abs(t.c{c} - (s.a{c} >> (16 - t.level)))" for c in "xyz")}) >= 2),
r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM far)
SELECT key, level, 0::INT AS vec_idx, round(sum({_LAPLACE["phi"]}), {VALUES}) + 0.0 AS phi FROM r GROUP BY ALL""")
def fmm_box_potentials(spark, d):
    """What each local expansion gives at the centre of its box: the sum over all sources beyond the boxes around it."""
    order = 8
    plan = _fast(spark, d, order=order)
    occupied = _leaves(spark, d, _targets(spark, d)).select(F.explode(M.ancestors(F.col("key"))).alias("key")).distinct()
    found = plan.locals().join(occupied, "key", "left_semi").select("key", "level", "vec_idx", F.posexplode("coeff").alias("point", "q"))
    surface = plan.surface(occupied.filter(M.level(F.col("key")) >= 2), surfaces.OUTER, order)
    away = [F.col(c) - centre for c, centre in zip("xyz", M.centre(F.col("key"), plan.domain), strict=True)]
    r = F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2])
    return _round(found.join(surface, ["key", "point"]).groupBy("key", "level", "vec_idx").agg(F.sum(F.col("q") / (FOUR_PI * r)).alias("phi")), "phi", digits=VALUES)


@query(f"""{_KEYED}, s AS (SELECT *, 1.0 + (row_number() OVER (ORDER BY leaf_key, gid)) % 7 AS w FROM src_k), t AS (SELECT *, row_number() OVER (ORDER BY leaf_key, gid) AS rank FROM tgt_k),
p AS (SELECT t.gid, t.rank, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz, s.w AS q FROM t, s), r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM p)
SELECT gid, rank, 0::INT AS vec_idx, round(sum({_LAPLACE["phi"]}), {VALUES}) + 0.0 AS phi FROM r GROUP BY ALL""")
def fmm_ordered_values(spark, d):
    """A plan cleared after its sums and given charges by rank in tree order; results with their ranks."""
    plan = _fast(spark, d, order=8)
    plan.evaluate()
    plan.clear()
    ranks = plan.source_tree.global_indices().select("rank", (1.0 + F.col("rank") % 7).alias("q"))
    return _round(plan.attach_charges_ordered(ranks).potentials_in_tree_order().select("gid", "rank", "vec_idx", "phi"), "phi", digits=VALUES)


@query(f"""WITH {_SETS}, v AS (SELECT unnest([1, 3])::INT AS vec_idx),
p AS (SELECT t.gid, vec_idx, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz, s.q * vec_idx + 1 AS q FROM tgt t, src s, v), r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM p)
SELECT gid, vec_idx, round(sum({_LAPLACE["phi"]}), {VALUES}) + 0.0 AS phi FROM r GROUP BY ALL""")
def fmm_vectors_values(spark, d):
    """Two right-hand sides at once, with larger check surfaces and cross approximation."""
    s = _points(spark, d)
    charges = s.select("gid", F.explode(F.array(F.lit(1), F.lit(3))).alias("vec_idx"), "q").withColumn("q", F.col("q") * F.col("vec_idx") + 1)
    plan = Builder(spark).tree(s, _targets(spark, d), depth=2).parameters(charges, 8, Laplace(), "Value", X.Aca(1e-12, surface_diff=1)).build()
    return _rounded(plan.evaluate())


@query(_direct_sql(_LAPLACE).replace(", 6)", ", 0)"))
def fmm_gradient_values(spark, d):
    """Potentials and gradients of order 10 in whole numbers (of values up to some 10,000, with errors of about 1e-4)."""
    return _round(_fast(spark, d, order=10, eval_type="ValueDeriv").evaluate().select("gid", "vec_idx", *_LAPLACE), *_LAPLACE, digits=0)


@query(_values_sql({"phi": _LAPLACE["phi"]}))
def fmm_variable_values(spark, d):
    """An order for each level."""
    return _rounded(_fast(spark, d, order=[7, 7, 9, 8]).evaluate())


@query(_values_sql(_HELMHOLTZ))
def fmm_helmholtz_values(spark, d):
    return _rounded(_fast(spark, d, order=8, kernel=Helmholtz(WAVENUMBER)).evaluate())


@query(_values_sql(_HELMHOLTZ))
def fmm_ia_values(spark, d):
    """Individually compressed far fields."""
    return _rounded(_fast(spark, d, order=7, m2l=X.Ia(1e-12), kernel=Helmholtz(WAVENUMBER), depth=2).evaluate())


@query(_values_sql(_YUKAWA))
def fmm_yukawa_values(spark, d):
    """A kernel of a user's own: real, without a degree of homogeneity."""
    return _rounded(_fast(spark, d, order=8, kernel=Yukawa(SCREENING)).evaluate())


@query(_values_sql({"phi": _LAPLACE["phi"]}, "CASE WHEN s.gid % 7 = 3 THEN 4 * s.q ELSE s.q END"))
def fmm_changed_charges(spark, d):
    """Every seventh charge changed: only those sources' boxes go up again, and what they give is added."""
    plan = _fast(spark, d, order=8)
    return _rounded(plan.change_charges(_points(spark, d).filter("gid % 7 = 3").select("gid", (F.col("q") * 4).alias("q"))).evaluate())


@query(_KEYED + f""", leaf AS (SELECT max(leaf_key) AS key FROM tgt_k),
p AS (SELECT t.gid, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz, s.q FROM (SELECT * FROM tgt_k WHERE leaf_key = (SELECT key FROM leaf)) t, src s), r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM p)
SELECT gid, 0::INT AS vec_idx, round(sum({_LAPLACE["phi"]}), {VALUES}) + 0.0 AS phi FROM r GROUP BY gid""")
def fmm_leaf_potentials(spark, d):
    """Potentials of the last occupied leaf alone: its near leaves and the boxes that it and those above it see."""
    plan = _fast(spark, d, order=8)
    return _rounded(plan.potential(plan.target_tree.points.agg(F.max("leaf_key")).first()[0]))


@query(_values_sql({"phi": _LAPLACE["phi"]}).replace("FROM tgt t, src s", "FROM src t, tgt s"))
def fmm_evaluate_kernel(spark, d):
    """A plan's kernel at any points: the two sets change places."""
    plan, s, t = _fast(spark, d, order=4), _points(spark, d), _targets(spark, d)
    return _rounded(plan.evaluate_kernel(t, s, _charges(t)))
