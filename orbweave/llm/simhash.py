"""Near duplicates by SimHash fingerprints, pigeonhole blocks and Hamming distance.

A document's fingerprint has a bit set where more than half of its shingles' XXH64 hashes (repeats included) have it. Fingerprints
that differ in at most ``distance`` bits link. Links are found among different fingerprints; copies of one are a single node.

1. Blocks. 64 bits are cut into ``blocks`` blocks; two fingerprints at most ``distance`` bits apart agree in at least blocks - distance of
   them. So each fingerprint is entered under every choice of that many blocks (15 choices of 2 of 6 by default, about 21 bits each), and
   linked ones share an entry.
2. Join on blocks. Entries are counted; what is alone leaves. Two fingerprints that are alone with each other are verified from the
   count's minimum and maximum. Larger buckets of up to ``BUCKET`` members are verified in Arrow batches, which give a spanning
   tree of each bucket's links and not its pairs.
3. Hot buckets. Every member is compared with the bucket's head, the fingerprint of most documents, and linked with it or not. Then
   the links so far are followed: a hot bucket of one component is done. In the others only members outside the main component are
   compared with the rest: both are entered under choices of blocks of the bits that the bucket leaves open, and an entry's outsiders meet
   its members chunk by chunk, in groups of at most two ``BUCKET``. Nothing is capped or dropped.

Nulls: a null text or one without words has fingerprint 0 and links like any other; fewer than k words are one shingle. Fingerprints alone link: a
row without an id links like any other and takes the smallest id that it reaches (null if it reaches none), and rows that repeat an id are
linked only if their fingerprints are. Ties go to the smaller fingerprint or id. A very long text is hashed in blocks of shingles in one task.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import forget, pieces, signed, sized, stored, text_rows, Words
from orbweave.llm.components import components

#: Members of a bucket that one task verifies at once.
BUCKET = 4096
#: Shingles hashed at once.
SHINGLES = 1 << 16


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and text of each shingle of a piece."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    first = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return first, np.minimum(first + k, words.first[1:][text]) - 1, text


def joined_by_spaces(words: Words, lo: int, hi: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words lo..hi - 1 with one space after each, and where each starts and ends."""
    size = words.end[lo:hi] - words.start[lo:hi]
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[start + size] = False
    out[inside] = words.data[np.repeat(words.start[lo:hi] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return out.tobytes(), start, start + size


def simhashes(column: pa.Array, k: int, seed: int) -> np.ndarray:
    """The fingerprint of each text of a piece."""
    words = Words(column, lower=True)
    first, last, text = shingles(words, k)
    votes = np.zeros((len(column), 64), np.int64)
    for i in range(0, len(first), SHINGLES):
        a, b, t = first[i : i + SHINGLES], last[i : i + SHINGLES], text[i : i + SHINGLES]
        data, start, end = joined_by_spaces(words, int(a[0]), int(b[-1]) + 1)
        hashes = np.array([xxhash.xxh64_intdigest(data[x:y], seed) for x, y in zip(start[a - a[0]].tolist(), end[b - a[0]].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        votes[t[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    most = 2 * votes > np.bincount(text, minlength=len(column))[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(simhashes(column, k, seed)))], names=["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fp long")


# ---- blocks -----------------------------------------------------------------------------------------------------------


def block_masks(bits: list[int], blocks: int, distance: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks of some bits."""
    parts = [sum(1 << int(b) for b in chunk) for chunk in np.array_split(bits, blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def masks(blocks: int, distance: int) -> list[int]:
    if blocks <= distance or blocks > 16:
        raise ValueError("more blocks than differing bits, and at most 16")
    return block_masks(list(range(64)), blocks, distance)


def finer_masks(mask: int, blocks: int, distance: int) -> list[int]:
    """The mask with every choice of blocks of the bits it leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in block_masks(free, blocks, distance)]


def masked(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def apart(a: Column, b: Column) -> Column:
    """How many bits two fingerprints differ in."""
    return F.bit_count(a.bitwiseXOR(b))


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of rows i and j in place; a root is its tree's smallest row."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def trees(group: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For rows sorted by group: the first row that each is linked with, through rows of its group."""
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[begins, len(group)])
    first, left = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes) - np.arange(len(group)) - 1
    near = np.bitwise_count(fp ^ fp[first]) <= distance
    root = np.where(near, first, np.arange(len(group)))
    whole = np.logical_and.reduceat(near, begins) if len(begins) else near
    at, shift = np.flatnonzero(np.repeat(~whole, sizes)), 1
    while len(at := at[left[at] >= shift]):
        hit = at[(np.bitwise_count(fp[at] ^ fp[at + shift]) <= distance) & (root[at] != root[at + shift])]
        if len(hit):
            merge(root, hit, hit + shift)
        shift += 1
    return root


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run of equal bucket columns (all but the last), and the last column."""
    change = np.zeros(len(batch), bool)
    for c in batch.columns[:-1]:
        v = c.to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change), batch.columns[-1].to_numpy()


def _verified(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """a, b: spanning links of the buckets of rows sorted by bucket. The last bucket of a batch waits for the next."""
    held = None
    for batch in batches:
        whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
        if not whole:
            continue
        group, fp = _pairs(whole[0])
        open_ = int(np.searchsorted(group, group[-1]))
        held = whole[0].slice(open_)
        yield _tree_links(group[:open_], fp[:open_], distance)
    if held is not None:
        yield _tree_links(*_pairs(held), distance)


def _tree_links(group: np.ndarray, fp: np.ndarray, distance: int) -> pa.RecordBatch:
    root = trees(group, fp.view(np.uint64), distance)
    child = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(fp[root[child]], pa.int64()), pa.array(fp[child], pa.int64())], names=["a", "b"])


def _outsiders_met(table: pa.Table, distance: int) -> pa.Table:
    """a, b: links of a chunk of outsiders (side 0) with a chunk of members (side 1), one for each pair of components they join."""
    side, fp, root = (table.column(c).to_numpy() for c in ("side", "fp", "root"))
    mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found, names = [], np.unique(root, return_inverse=True)[1]
    tree = np.arange(names.max() + 1)
    f = fp.view(np.uint64)
    for i in mine.tolist():
        hit = theirs[(np.bitwise_count(f[theirs] ^ f[i]) <= distance) & (tree[names[theirs]] != tree[names[i]])]
        if len(hit):
            hit = hit[np.unique(tree[names[hit]], return_index=True)[1]]
            found += [(int(fp[i]), int(fp[j])) for j in hit]
            merge(tree, np.full(len(hit), names[i]), names[hit])
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def entered(prints: DataFrame, choices: list[int], *more: str) -> DataFrame:
    """choice, value, fp and other columns: each fingerprint under every choice of blocks."""
    values = F.array(*[masked(F.col("fp"), m) for m in choices])
    return prints.select("fp", *more, F.posexplode(values).alias("choice", "value")).select("choice", "value", "fp", *more)


def hot_links(hot: DataFrame, links: DataFrame, choices: list[int], blocks: int, distance: int, bucket: int, spent: list[DataFrame]) -> DataFrame:
    """a, b: what the members of hot buckets (choice, value, fp) link, given links already found (those with the buckets' heads among them)."""
    roots = components(links, "simhash-hot")
    named = hot.join(roots, hot.fp == roots.node, "left").select("choice", "value", "fp", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-named")
    main = named.groupBy("choice", "value", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("choice", "value").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    main = stored(main.filter("roots > 1").select("choice", "value", "main"), "simhash-main")
    several = named.join(sized(main), ["choice", "value"]).withColumn("out", F.col("root") != F.col("main"))
    finer = F.array(*[F.array(*[masked(F.lit(-1).cast("long"), m) for m in finer_masks(c, blocks, distance)]) for c in choices])
    parts = F.transform(F.element_at(finer, F.col("choice") + 1), lambda m: F.col("fp").bitwiseAND(m))
    split = several.select(F.posexplode(parts).alias("finer", "part"), "choice", "fp", "root", "out")
    key = ["choice", "finer", "part"]
    split = stored(split.join(stored(split.filter("out").select(*key).distinct(), "simhash-open"), key, "left_semi"), "simhash-split")
    counts = split.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("out").cast("long")).alias("outs")).filter("n > 1")
    counts = stored(counts.select(*key, F.ceil(F.col("n") / bucket).cast("int").alias("chunks"), F.ceil(F.col("outs") / bucket).cast("int").alias("teams")), "simhash-chunks")
    rows = split.join(counts, key)
    mine = lambda k: F.array(F.pmod(F.xxhash64("fp"), F.col(k)).cast("int"))
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    outs = rows.filter("out").select(*key, F.explode(mine("teams")).alias("team"), F.lit(0).alias("side"), "fp", "root", every("chunks").alias("chunks"))
    members = rows.select(*key, F.explode(every("teams")).alias("team"), F.lit(1).alias("side"), "fp", "root", mine("chunks").alias("chunks"))
    met = outs.unionByName(members).withColumn("chunk", F.explode("chunks")).drop("chunks")
    spent += [roots, named, main, split, counts]
    return met.groupBy(*key, "team", "chunk").applyInArrow(lambda t: _outsiders_met(t, distance), "a long, b long")


def print_links(prints: DataFrame, blocks: int = 6, distance: int = 4, bucket: int = BUCKET, spent: list[DataFrame] | None = None) -> DataFrame:
    """a, b (stored): links whose components are those of all pairs of fingerprints at most ``distance`` bits apart. prints: fp (each once), docs."""
    spent = [] if spent is None else spent
    choices = masks(blocks, distance)
    fp = F.col("fp")
    key = ["choice", "value"]
    entries = entered(prints, choices, "docs")
    buckets = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("n > 1")
    buckets = stored(buckets, "simhash-buckets")
    pairs = buckets.filter((F.col("n") == 2) & (apart(F.col("low"), F.col("high")) <= distance)).select(F.col("low").alias("a"), F.col("high").alias("b"))
    some = buckets.filter(F.col("n").between(3, bucket)).select(*key)
    # dealt by a hash: Spark leaves out a shuffle by the join's own keys, and where it splits a skewed join, buckets would come apart
    some = entries.join(some, key).select(*key, "fp").repartition(F.xxhash64(*key)).sortWithinPartitions(*key, "fp")
    links = stored(pairs.union(some.mapInArrow(lambda batches: _verified(batches, distance), "a long, b long")), "simhash-links")
    crowded = stored(buckets.filter(F.col("n") > bucket).select(*key), "simhash-crowded")
    spent += [buckets, links, crowded]
    if crowded.isEmpty():
        return links
    hot = stored(entries.join(sized(crowded), key), "simhash-hot")
    heads = stored(hot.groupBy(*key).agg(F.max_by("fp", F.struct("docs", -fp)).alias("head")), "simhash-heads")
    starred = hot.join(sized(heads), key).filter((fp != F.col("head")) & (apart(fp, F.col("head")) <= distance)).select(F.col("head").alias("a"), fp.alias("b"))
    links = stored(links.union(starred).distinct(), "simhash-links")
    more = hot_links(hot.select(*key, "fp"), links, choices, blocks, distance, bucket, spent)
    spent += [hot, heads, links]
    return stored(links.union(more), "simhash-links")


def linked_documents(docs: DataFrame, k: int = 4, seed: int = 42, distance: int = 4, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of a row that its fingerprint reaches) for each row of docs."""
    spent: list[DataFrame] = []
    rows = stored(fingerprints(docs, k, seed), "simhash-rows")
    prints = stored(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("doc")), "simhash-prints")
    links = print_links(prints, blocks, distance, bucket, spent)
    roots = components(links, "simhash")
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "simhash-placed")
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = stored(placed.join(least, "root").select("fp", "component_id"), "simhash-components")
    for used in [*spent, links, roots, prints, placed]:
        forget(used)
    return rows.join(sized(named), "fp").select("doc_id", "fp", "component_id")
