"""Interaction lists as equi-joins on exploded keys, and direct sums."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave import schemas
from orbweave.functions import boxes, kernels
from orbweave.functions import morton as M
from orbweave.plans.storage import stored
from orbweave.schemas import MAX_DEPTH


def u_list(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """target, source: each target leaf with itself and its neighbours that are source leaves. Both have a column key."""
    near = targets.select(F.col("key").alias("target"), F.explode(F.array_union(F.array("key"), M.neighbours(F.col("key")))).alias("source"))
    return near.join(sources.select(F.col("key").alias("source")), "source").select("target", "source")


def v_list(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """level, target, source, tv: the children of the parent's neighbours that don't touch the target, levels 2 and deeper.

    Keys are decoded once for each box, before the lists are made; boxes of a level then touch where no axis differs by 2 or more.
    """
    boxes = lambda df, name: df.filter(M.level(F.col("key")) >= 2).select(F.col("key").alias(name), M.parent(F.col("key")).alias("parent"), *[x.alias(f"{name}_{c}") for x, c in zip(M.anchor(F.col("key")), "xyz", strict=True)])
    halo = boxes(targets, "target").withColumn("level", M.level(F.col("target"))).withColumn("parent", F.explode(M.neighbours(F.col("parent"))))
    pairs = halo.join(boxes(sources, "source"), "parent")
    step = F.pow(F.lit(2), F.lit(MAX_DEPTH) - F.col("level"))
    pairs = pairs.select("level", "target", "source", *[((F.col(f"source_{c}") - F.col(f"target_{c}")) / step).cast("int").alias(f"d{c}") for c in "xyz"])
    pairs = pairs.filter(F.greatest(*[F.abs(f"d{c}") for c in "xyz"]) >= 2)
    return pairs.select("level", "target", "source", M.transfer_hash(F.col("dx"), F.col("dy"), F.col("dz")).alias("tv"))


def mixed_u_list(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """target, source: each target leaf with itself and the source leaves that touch it, for leaves (key) of one balanced tree.

    Leaves that touch are at most one level apart, so they meet by equality: a target with its neighbours and their parents, and a
    finer source's neighbours' parents with the target.
    """
    parents = lambda c: F.array_distinct(F.transform(M.neighbours(F.col(c)), M.parent))
    t, s = targets.select(F.col("key").alias("target")), sources.select(F.col("key").alias("source"))
    near = t.select("target", F.explode(F.concat(F.array("target"), M.neighbours(F.col("target")), F.when(M.level(F.col("target")) > 0, parents("target")).otherwise(F.array().cast("array<long>")))).alias("source"))
    finer = s.filter(M.level(F.col("source")) > 0).select("source", F.explode(parents("source")).alias("target"))
    return near.join(s, "source").select("target", "source").union(finer.join(t, "target").select("target", "source"))


def w_list(leaves: DataFrame, boxes: DataFrame) -> DataFrame:
    """leaf, box: the boxes (key) one level below a leaf (key) of one balanced tree whose parents touch the leaf while they don't. A join
    of the leaf's neighbours with the boxes' parents; with targets' leaves and sources' boxes the W list."""
    near = leaves.select(F.col("key").alias("leaf"), F.explode(M.neighbours(F.col("key"))).alias("parent"))
    below = boxes.filter(M.level(F.col("key")) > 0).select(F.col("key").alias("box"), M.parent(F.col("key")).alias("parent"))
    return near.join(below, "parent").filter(~M.touches(F.col("leaf"), F.col("box"))).select("leaf", "box")


def x_list(boxes: DataFrame, leaves: DataFrame) -> DataFrame:
    """target, source: the W list the other way round, targets' boxes with sources' leaves."""
    return w_list(leaves, boxes).select(F.col("box").alias("target"), F.col("leaf").alias("source"))


def family(boxes: DataFrame) -> DataFrame:
    """parent, child: the joins of the upward and downward passes."""
    return boxes.filter("parent is not null").select("parent", F.col("key").alias("child"))


#: Sources, and bytes of their coordinates and charges, up to which a direct sum sends one block of sources to all tasks.
SOURCE_BLOCK, SOURCE_BYTES = 100_000, 32 << 20
#: Pairs up to which sums are left to the tasks that read the targets, and pairs of a task beyond that.
FEW_PAIRS, TASK_PAIRS = 1 << 24, 1 << 32
#: Edge of a near field's blocks, as levels above the leaves in it.
NEAR_BLOCK = 2
#: Targets that a task sums for at once.
TARGET_RUN = 1 << 16


def direct(targets: DataFrame, sources: DataFrame, charges: DataFrame, kernel, gradient: bool = False, block: int = SOURCE_BLOCK) -> DataFrame:
    """gid, vec_idx and the exact sums over all sources. The work is all pairs by definition.

    Sources and targets need different gids, none of them null, and every source a charge: anything else is an error, however many there are.
    Up to ``block`` sources (of at most ``SOURCE_BYTES``) are broadcast and targets stream past them. More are cut into blocks of about
    that many by a hash of the id, targets into chunks likewise; each (chunk, block) is one group of bounded size, evaluated
    in numpy, and the partial sums are added by target.
    """
    names = kernels.result_columns(kernel, gradient)
    n, m = schemas.counted(sources, "sources"), schemas.counted(targets, "targets")
    loaded = schemas.charged(sources.select("gid", "x", "y", "z"), charges)
    vecs = sorted(r[0] for r in charges.select("vec_idx").distinct().collect())
    block = max(1, min(block, SOURCE_BYTES // (8 * (3 + len(vecs) * (2 if kernel.complex else 1)))))
    rows = targets.select("gid", "x", "y", "z")
    schema = "gid long, vec_idx int, " + ", ".join(f"{x} double" for x in names)
    spark = sources.sparkSession
    if n <= block:
        sent = spark.sparkContext.broadcast(charge_matrix(loaded.select("gid", "x", "y", "z", "vec_idx", "q", "q_im").toPandas(), vecs, kernel.complex))
        if n * m > FEW_PAIRS:  # a table may be one row group, and so one task
            cores = spark.sparkContext.defaultParallelism
            rows = rows.repartition(cores * -(-n * m // (cores * TASK_PAIRS)))
        return rows.mapInArrow(_summing(kernel, sent, vecs, gradient), schema)
    blocks = -(-n // block)
    chunks = max(1, -(-m // block), -(-spark.sparkContext.defaultParallelism // blocks) if n * m > FEW_PAIRS else 1)
    part = lambda k: F.pmod(F.xxhash64("gid"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = rows.select(part(chunks).alias("chunk"), every(blocks).alias("block"), F.lit(0).alias("kind"), "gid", "x", "y", "z", F.lit(0).alias("vec_idx"), F.lit(0.0).alias("q"), F.lit(0.0).alias("q_im"))
    theirs = loaded.select(every(chunks).alias("chunk"), part(blocks).alias("block"), F.lit(1).alias("kind"), "gid", "x", "y", "z", "vec_idx", "q", "q_im")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            frame = pa.Table.from_batches(found).to_pandas()
            mine, others = frame[frame.kind == 0], frame[frame.kind == 1]
            xyz, q = charge_matrix(others, vecs, kernel.complex)
            sums = kernels.evaluate(kernel, mine[["x", "y", "z"]].to_numpy(float), xyz, q, gradient)
            yield result_batch(mine.gid.to_numpy(), vecs, sums if gradient else sums[None], kernel, gradient)

    groups = own.union(theirs).repartitionById(chunks * blocks, F.col("chunk") * blocks + F.col("block")).drop("chunk", "block")
    return groups.mapInArrow(meet, schema).groupBy("gid", "vec_idx").agg(*[F.sum(x).alias(x) for x in names])


def near_field(targets: DataFrame, sources: DataFrame, charges: DataFrame, kernel, gradient: bool = False) -> DataFrame:
    """Sums over the U list: the targets that have sources in their leaf or around it, by right-hand side.

    targets and sources carry gid, x, y, z, leaf_key; gids and charges are checked as in ``direct``. Leaves below the box ``NEAR_BLOCK`` levels up
    meet the leaves around them in one group, summed in numpy; a block of many pairs becomes several groups by shares of both sets.
    """
    with ThreadPoolExecutor(2) as both:  # keys are made once, the jobs of the two sets run side by side
        sources, targets = both.map(lambda p, name: stored(p.select("gid", "x", "y", "z", "leaf_key"), name), (sources, targets), ("near-sources", "near-targets"))
        n, m = both.map(schemas.counted, (sources, targets), ("sources", "targets"))
    names = kernels.result_columns(kernel, gradient)
    vecs = sorted(r[0] for r in charges.select("vec_idx").distinct().collect())
    home = lambda k: M.at_level(k, F.greatest(M.level(k) - NEAR_BLOCK, F.lit(0)))
    block = lambda k: F.struct(k.alias("home"), M.level(F.col("leaf_key")).alias("level")).alias("block")
    leaves = lambda df, name: df.groupBy("leaf_key").agg(F.count(F.lit(1)).alias(name))
    # blocks are made for each leaf, not for each point: a leaf's neighbours are a long expression
    mine = stored(leaves(targets, "n").select("leaf_key", block(home(F.col("leaf_key"))), "n"), "near-blocks")
    around = F.array_distinct(F.transform(F.array_union(F.array("leaf_key"), M.neighbours(F.col("leaf_key"))), home))
    near = leaves(sources, "m").select("leaf_key", F.explode(around).alias("home"), "m").select("leaf_key", block(F.col("home")), "m")
    near = stored(near.join(mine.select("block").distinct(), "block", "left_semi").select("leaf_key", "block", "m"), "near-blocks")
    own = targets.join(mine, "leaf_key").select("block", F.lit(0).alias("kind"), F.col("leaf_key").alias("key"), "gid", "x", "y", "z", F.lit(0).alias("vec_idx"), F.lit(0.0).alias("q"), F.lit(0.0).alias("q_im"))
    theirs = schemas.charged(sources.select("gid", "x", "y", "z", "leaf_key"), charges).join(near, "leaf_key")
    theirs = theirs.select("block", F.lit(1).alias("kind"), F.col("leaf_key").alias("key"), "gid", "x", "y", "z", "vec_idx", "q", "q_im")
    crowded = None
    if n * m > FEW_PAIRS:
        crowded = shares(mine.groupBy("block").agg(F.sum("n").alias("n")).join(near.groupBy("block").agg(F.sum("m").alias("m")), "block"), NEAR_POINTS)
    schema = "gid long, vec_idx int, " + ", ".join(f"{x} double" for x in names)
    return shared(own.union(theirs), crowded, _near_leaves(kernel, vecs, gradient), schema, names)


#: Points (targets, and sources in and around) a block of leaves may hold before it is split over several tasks.
NEAR_POINTS = 500_000


def task_pairs(spark, pairs: int) -> int:
    """Pairs of a task where there are so many: about four tasks a core, within bounds."""
    return min(max(pairs // (4 * spark.sparkContext.defaultParallelism), TASK_PAIRS >> 4), TASK_PAIRS)


def shares(sizes: DataFrame, most: int) -> tuple[DataFrame, int] | None:
    """Of blocks (block, n targets, m sources in and around): those of more than ``most`` points or too many pairs for a task, stored with their parts, and how
    many groups ``shared`` makes of them; None if there are none."""
    sizes = stored(sizes, "crowded")
    pairs = F.col("n").cast("double") * F.col("m")
    limit = task_pairs(sizes.sparkSession, int(sizes.agg(F.sum(pairs)).first()[0] or 0))
    parts = F.ceil(F.greatest((F.col("n") + F.col("m")) / most, F.sqrt(pairs / limit))).cast("int")
    found = sizes.select("block", parts.alias("parts")).filter("parts > 1")
    groups = found.agg(F.sum(F.col("parts") * F.col("parts"))).first()[0]
    return (found, groups) if groups else None


def shared(rows: DataFrame, crowded: tuple[DataFrame, int] | None, work, schema: str, names: list[str]) -> DataFrame:
    """Sums by gid and vec_idx of ``work`` on each block of rows (targets are of kind 0, sources of kind 1, others go with the first share of sources).
    A crowded block becomes parts x parts groups: a share of its targets meets a share of its sources."""
    if crowded is None:
        return rows.groupBy("block").applyInArrow(work, schema)
    found, groups = crowded
    rows = rows.join(F.broadcast(found) if groups <= MANY_GROUPS else found, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    mine = F.array(F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    kind = F.col("kind")
    rows = rows.withColumn("t", F.explode(F.when(kind == 0, mine).otherwise(every)))
    rows = rows.withColumn("s", F.explode(F.when(kind == 0, every).when(kind == 1, mine).otherwise(F.array(F.lit(0)))))
    # twice as many partitions as groups, so that few share a task
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) + min(2 * groups, 64 * spark.sparkContext.defaultParallelism)
    made = rows.drop("parts").repartition(n, "block", "t", "s").groupBy("block", "t", "s").applyInArrow(work, schema)
    return made.groupBy("gid", "vec_idx").agg(*[F.sum(x).alias(x) for x in names])


#: Groups up to which the table of crowded blocks is broadcast.
MANY_GROUPS = 2000


def _near_leaves(kernel, vecs: list[int], gradient: bool):
    def run(table: pa.Table) -> pa.Table:
        frame = table.select(["kind", "key", "gid", "x", "y", "z", "vec_idx", "q", "q_im"]).to_pandas()
        sources = frame[frame.kind == 1]
        by_leaf = {k: (*charge_matrix(p, vecs, kernel.complex), set(p.vec_idx)) for k, p in sources.groupby("key")}
        out = [result_batch(np.empty(0, np.int64), vecs, np.zeros((4 if gradient else 1, 0, len(vecs)), complex if kernel.complex else float), kernel, gradient)]
        for key, part in frame[frame.kind == 0].groupby("key"):
            found = [by_leaf[k] for k in leaves_around(key).tolist() if k in by_leaf]
            if found:
                sums = kernels.evaluate(kernel, part[["x", "y", "z"]].to_numpy(float), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), gradient)
                sums = sums if gradient else sums[None]
                here = sorted(set().union(*(f[2] for f in found)))  # right-hand sides that a source around has
                out.append(result_batch(part.gid.to_numpy(), here, sums[:, :, np.searchsorted(vecs, here)], kernel, gradient))
        return pa.Table.from_batches(out)

    return run


def leaves_around(key: int) -> np.ndarray:
    """A box and those of its level around it, as keys."""
    level = key & M.LEVEL_MASK
    cells = boxes.grid(np.array([key]), level) + np.array([(0, 0, 0), *M.DIRECTIONS])
    return boxes.key_of(cells[((cells >= 0) & (cells < 1 << level)).all(1)], level)


def charge_matrix(frame, vecs: list[int], complex_: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (n, 3) and charges (n, vecs) of rows gid, x, y, z, vec_idx, q, q_im."""
    gids, first, at = np.unique(frame.gid.to_numpy(), return_index=True, return_inverse=True)
    xyz = frame[["x", "y", "z"]].to_numpy(float)[first] if len(gids) else np.zeros((0, 3))
    q = np.zeros((len(gids), len(vecs)), complex if complex_ else float)
    value = frame.q.to_numpy(float) + (1j * frame.q_im.to_numpy(float) if complex_ else 0)
    np.add.at(q, (at, np.searchsorted(vecs, frame.vec_idx.to_numpy())), value)
    return xyz, q


def result_batch(gids: np.ndarray, vecs: list[int], sums: np.ndarray, kernel, gradient: bool) -> pa.RecordBatch:
    """sums (width, n, vecs) as rows gid, vec_idx and the result columns."""
    n, v = len(gids), len(vecs)
    columns = [pa.array(np.repeat(gids, v)), pa.array(np.tile(np.array(vecs, np.int32), n))]
    for part in sums:
        flat = np.ascontiguousarray(part.reshape(-1))
        columns += [pa.array(flat.real.copy()), pa.array(flat.imag.copy())] if kernel.complex else [pa.array(flat.real.copy())]
    return pa.RecordBatch.from_arrays(columns, names=["gid", "vec_idx", *kernels.result_columns(kernel, gradient)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to ``TARGET_RUN`` rows, if one isn't more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(map(len, held)) + len(batch) > TARGET_RUN:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _summing(kernel, sent, vecs, gradient):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xyz, q = sent.value
        for run in _runs(batches):
            at = np.stack([run.column(i).to_numpy() for i in (1, 2, 3)], 1)
            sums = kernels.evaluate(kernel, at, xyz, q, gradient)
            yield result_batch(run.column(0).to_numpy(), vecs, sums if gradient else sums[None], kernel, gradient)

    return summed


def direct_sql(targets: DataFrame, sources: DataFrame, charges: DataFrame, kernel, gradient: bool = False) -> DataFrame:
    """``direct`` as a plain theta join and sum with one broadcast of sources. More than ``SOURCE_BLOCK`` meet the targets block by chunk, as ``direct`` has it."""
    n, m = schemas.counted(sources, "sources"), schemas.counted(targets, "targets")
    if n > SOURCE_BLOCK:
        return direct(targets, sources, charges, kernel, gradient)
    loaded = schemas.charged(sources.select("gid", "x", "y", "z"), charges).select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "vec_idx", "q", "q_im")
    terms = kernel.columns(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"), F.col("z") - F.col("sz"), F.col("q"), F.col("q_im"))
    rows = targets.select("gid", "x", "y", "z")
    rows = rows.repartition(4 * sources.sparkSession.sparkContext.defaultParallelism) if n * m > FEW_PAIRS else rows
    return rows.join(F.broadcast(loaded), F.lit(True)).groupBy("gid", "vec_idx").agg(*[F.sum(terms[n]).alias(n) for n in kernels.result_columns(kernel, gradient)])


def l2_error(found: DataFrame, exact: DataFrame, value: str = "phi") -> DataFrame:
    """One row ``l2_error`` of two result tables keyed by gid, vec_idx."""
    both = found.select("gid", "vec_idx", F.col(value).alias("f")).join(exact.select("gid", "vec_idx", F.col(value).alias("e")), ["gid", "vec_idx"])
    return both.agg(F.sqrt(F.sum(F.pow(F.col("f") - F.col("e"), 2)) / F.sum(F.pow(F.col("e"), 2))).alias("l2_error"))
