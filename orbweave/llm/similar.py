"""N-gram Jaccard join by prefix filtering with set-relation skipping.

A document's set is its distinct ``k``-word shingles (64-bit hashes). Two documents link when their Jaccard similarity is at
least ``percent``. Links between different sets are found exactly, without emitting the pairs of a group:

1. Activation. With tokens in hash order, a set with a link shares at least ``need`` of its first ``prefix + extra``
   tokens with the partner's, whatever size the threshold allows the partner; sets that share fewer with anyone at all
   have no link and leave. Only these first tokens are counted over the corpus.
2. Set classes. Equal active sets become one class, named by the hash (mark) of the set; its smallest doc_id stands for it. One
   doc_id can stand for several classes.
3. Index lists. Tokens of the class sets are ordered rarest first, which makes the lists of the ``prefix`` tokens short;
   a set with enough tokens of its own has no entry. Entries carry size and position.
4. Answers of the head. Each list has a head (the member with the fewest tokens of its own). Members are compared with heads
   only, one row per (member, head): the row keeps the overlap and the two differences. Members that link with their head join
   its component; among the members of one component no pair is looked at.
5. Block skipping. A list is cut into blocks of one component, size class and position class. Two blocks are skipped where the
   positions, the sizes or the overlaps with the head leave no pair that could link; where the overlaps with the head
   say that every pair links, the two components are joined without opening the blocks. Size classes are join keys, so blocks of
   sizes that can't link never meet.
6. Derived answers. Pairs of the blocks that are opened are answered from the head's answers: with differences x - h, h - x, y - h and
   h - y, the overlap is the head's size less the union of what x and y lack of it plus what both add to it. Whole sets are not
   read again; near the head the differences are a few tokens.

Nulls: a null text or one without words has the empty set and links with nothing. With fewer than k words the whole sequence is the
only shingle. A null id is a row without links of its own. Rows that repeat an id are one document with the sets of all its rows
linked (same id). Ties are broken by doc_id. A very long text is one set in one task. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import forget, gram_hashes, lists, pieces, signed, sized, span_hashes, stored, text_rows, U, Words
from orbweave.llm.components import components

_CLASH = U(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a piece."""
    words = Words(column, lower=True)
    h = words.hashes()
    grams = gram_hashes(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    """How many first tokens suffice to meet every set of at least that similarity."""
    return n - -(-percent * n // 100) + 1


def head_length(n: int, percent: int, extra: float) -> int:
    """How many first tokens of a set of n are counted over the corpus."""
    p = prefix_length(n, percent)
    return min(n, p + int(extra * p))


@lru_cache(1 << 16)
def head_need(n: int, percent: int, extra: float) -> int:
    """The fewest tokens that the heads of a set of n and of any set it links with share.

    Of an overlap of o tokens at least o - (n - head) lie in the head that ends first in hash order, and so in both.
    """
    b = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    o = -(-percent * (n + b) // (100 + percent))
    p = b + percent * b // -100 + 1
    head = np.minimum(b, p + (extra * p).astype(np.int64))
    return int(np.minimum(o - (n - head_length(n, percent, extra)), o - (b - head)).min())


def _heads(batches: Iterator[pa.RecordBatch], k: int, percent: int, extra: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, column in pieces(batch):
            sets = shingle_sets(column, k)
            sizes = np.array([len(s) for s in sets])
            needs, firsts = [], []
            for n, s in zip(sizes.tolist(), sets, strict=True):
                needs.append(head_need(n, percent, extra) if n else 0)
                firsts.append(signed(s[: head_length(n, percent, extra)]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), lists(np.concatenate(firsts), np.array([len(x) for x in firsts]), pa.int64())],
                names=["doc_id", "n", "need", "tokens"],
            )


def _whole(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, column in pieces(batch):
            sets = shingle_sets(column, k)
            marks = [signed(span_hashes(s.view(np.uint8), np.array([0]), np.array([8 * len(s)])))[0] if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.int64()), lists(signed(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64())],
                names=["doc_id", "n", "mark", "tokens"],
            )


def _prefix(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100.0 - 1e-9) + 1


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows x, y, a, b, left, right (sorted arrays): x, y, a, b, sizes, overlap, what left adds to right and what it lacks."""
    for batch in batches:
        both, added, lacking, sizes = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for left, right in zip(batch.column(4), batch.column(5), strict=True):
            x, y = left.values.to_numpy(), right.values.to_numpy()
            inside = np.isin(x, y, assume_unique=True, kind="sort")
            both.append(int(inside.sum()))
            sizes.append((len(x), len(y)))
            added.append(x[~inside])
            lacking.append(y[~np.isin(y, x, assume_unique=True, kind="sort")])
        n = np.array(sizes, np.int64).reshape(-1, 2)
        counts = lambda parts: np.array([len(v) for v in parts[1:]], np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(n[:, 0], pa.int32()), pa.array(n[:, 1], pa.int32()), pa.array(both, pa.int32()), lists(np.concatenate(added), counts(added), pa.int64()), lists(np.concatenate(lacking), counts(lacking), pa.int64())],
            names=["x", "y", "a", "b", "nx", "ny", "both", "added", "lacking"],
        )


def _answers(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Overlaps and differences of the pairs of marks x, y. Each side's set is joined to the pair row; a hot set is split by skew handling."""
    left = pairs.join(sets.select(F.col("mark").alias("x"), F.col("rep").alias("a"), F.col("tokens").alias("left")), "x")
    both = left.join(sets.select(F.col("mark").alias("y"), F.col("rep").alias("b"), F.col("tokens").alias("right")), "y").select("x", "y", "a", "b", "left", "right")
    return both.mapInArrow(_compared, "x long, y long, a long, b long, nx int, ny int, both int, added array<long>, lacking array<long>")


def _links(both: Column, n: Column, percent: int) -> Column:
    """Whether an overlap links two sets of n tokens together."""
    return 100 * both.cast("long") >= percent * (n.cast("long") - both)


def block_links(index: DataFrame, head: DataFrame, answers: DataFrame, roots: DataFrame, percent: int, spent: list[DataFrame]) -> DataFrame:
    """a, b: links between components that the lists hold, by skipping blocks and deriving answers from those of the heads."""
    t = percent / 100.0
    known = answers.select(F.col("x").alias("mark"), F.col("y").alias("h"), F.col("both"))
    entry = index.join(head.select("token", F.col("y").alias("h"), F.col("n").alias("nh")), "token")
    entry = entry.join(known, ["mark", "h"], "left").withColumn("both", F.coalesce("both", "n"))  # the head itself has no row
    entry = entry.join(roots, entry.rep == roots.node, "left").withColumn("root", F.coalesce("root", "rep"))
    entry = entry.withColumn("size", F.floor(F.log(F.col("n")) / F.lit(max(-math.log(t), 0.01) + 1e-9)).cast("int")).withColumn("place", F.floor(F.log2(F.col("pos") + 1)).cast("int"))
    entry = stored(entry.select("token", "h", "nh", "root", "size", "place", "rep", "mark", "n", "both", (F.col("n") - F.col("pos")).alias("rest")), "similar-entries")
    many = stored(entry.groupBy("token").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one != other").select("token"), "similar-many")
    block = ["token", "root", "size", "place"]
    measures = [F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.min("both").alias("low"), F.max("both").alias("high"), F.max(F.col("n") - F.col("both")).alias("beyond"), F.first("nh").alias("nh")]
    bounds = stored(entry.groupBy(*block).agg(*measures).join(many, "token", "left_semi"), "similar-bounds")
    # sizes that can link lie in one class or in neighbouring ones: the second side stands in its own and in the next higher one
    x = bounds.select("token", F.col("size").alias("near"), *[F.col(c).alias(f"x_{c}") for c in bounds.columns if c != "token"])
    y = bounds.select("token", F.explode(F.array("size", F.col("size") + 1)).alias("near"), *[F.col(c).alias(f"y_{c}") for c in bounds.columns if c != "token"])
    c = F.col
    need = (c("x_least") + c("y_least")) * (t / (1 + t)) - 1e-6
    fits = (c("x_root") != c("y_root")) & ((c("x_size") != c("y_size")) | (c("x_root") < c("y_root")))
    fits &= (c("x_least") * t <= c("y_most") + 1e-6) & (c("y_least") * t <= c("x_most") + 1e-6)
    fits &= (F.least("x_rest", "y_rest") >= need) & (F.least("x_high", "y_high") + F.least("x_beyond", "y_beyond") >= need)
    sure = c("x_low") + c("y_low") - c("x_nh") >= (c("x_most") + c("y_most")) * (t / (1 + t)) + 1e-6
    pairs = stored(x.join(y, ["token", "near"]).filter(fits).select("token", *[c(f"{s}_{k}") for s in "xy" for k in ("root", "size", "place")], sure.alias("sure")), "similar-open")
    side = lambda s: entry.select("token", *[c(k).alias(f"{s}_{k}") for k in ("root", "size", "place")], c("h") if s == "x" else c("nh"), c("mark").alias(s), *[c(k).alias(f"{k}{s}") for k in ("rep", "n", "both", "rest")])
    key = lambda s: ["token", *[f"{s}_{k}" for k in ("root", "size", "place")]]
    opened = pairs.filter("not sure").join(side("x"), key("x")).join(side("y"), key("y"))
    need = (c("nx") + c("ny")) * (t / (1 + t)) - 1e-6
    opened = opened.filter((F.least("restx", "resty") >= need) & (F.least("bothx", "bothy") + F.least(c("nx") - c("bothx"), c("ny") - c("bothy")) >= need))
    opened = opened.groupBy("x", "y").agg(F.min(F.struct("h", "nh")).alias("h"), *[F.first(k).alias(k) for k in ("repx", "repy", "nx", "ny")]).select("x", "y", "h.h", "h.nh", "repx", "repy", "nx", "ny")
    opened = stored(opened, "similar-opened")
    none = F.array().cast("array<long>")
    delta = lambda s: answers.select(c("x").alias(s), c("y").alias("h"), c("added").alias(f"added{s}"), c("lacking").alias(f"lacking{s}"))
    derived = opened.join(delta("x"), ["x", "h"], "left").join(delta("y"), ["y", "h"], "left")
    part = lambda k: [F.coalesce(f"{k}{s}", none) for s in "xy"]
    both = c("nh") - F.size(F.array_union(*part("lacking"))) + F.size(F.array_intersect(*part("added")))
    spent += [entry, many, bounds, pairs, opened]
    links = derived.filter(_links(both, c("nx") + c("ny"), percent)).select(c("repx").alias("a"), c("repy").alias("b"))
    return links.union(pairs.filter("sure").select("x_root", "y_root"))


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80, extra: float = 0.5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. Memory of a task is bounded by a document's set."""
    rows = text_rows(docs)
    heads = stored(rows.mapInArrow(lambda batches: _heads(batches, k, percent, extra), "doc_id long, n int, need int, tokens array<long>"), "similar-heads")
    sizes = heads.select("doc_id", F.col("n").cast("long").alias("n_shingles"))

    entries = heads.filter("doc_id is not null").select("doc_id", "need", F.explode("tokens").alias("token"))
    # aggregates that join their own input are stored first: both sides of the join are exchanged then, and hot keys can be split
    shared = stored(entries.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("token"), "similar-shared")
    active = entries.join(shared, "token").groupBy("doc_id").agg(F.count(F.lit(1)).alias("got"), F.min("need").alias("need")).filter("got >= need").select("doc_id")
    active = stored(active, "similar-active")
    forget(shared)
    chosen = rows.filter("doc_id is not null and text is not null").join(sized(active), "doc_id", "left_semi")
    whole = stored(chosen.mapInArrow(lambda batches: _whole(batches, k), "doc_id long, n int, mark long, tokens array<long>").filter("n > 0"), "similar-sets")

    forget(active)
    classes = stored(whole.groupBy("mark", "n").agg(F.min("doc_id").alias("rep")), "similar-classes")
    members = whole.select("doc_id", "mark", "n").join(classes, ["mark", "n"]).filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    members = stored(members, "similar-members")
    sets = whole.join(classes.select(F.col("rep").alias("doc_id"), "mark", "n"), ["doc_id", "mark", "n"], "left_semi")
    sets = stored(sets.select(F.col("doc_id").alias("rep"), "mark", "n", "tokens").dropDuplicates(["rep", "mark", "n"]), "similar-classes-sets")
    forget(whole)
    forget(classes)

    tokens = sets.select("mark", F.explode("tokens").alias("token"))
    often = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "similar-often")
    ordered = tokens.join(often, "token").groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
    placed = ordered.join(sets.select("rep", "mark", "n"), "mark").withColumn("own", F.col("n") - F.size("common"))
    placed = placed.withColumn("room", _prefix(F.col("n"), percent) - F.col("own")).filter("room > 0")
    index = placed.select("rep", "mark", "n", "own", F.posexplode(F.slice("common", F.lit(1), F.col("room").cast("int"))).alias("i", "t"))
    index = stored(index.select("rep", "mark", "n", "own", (F.col("own") + F.col("i")).alias("pos"), F.col("t.token").alias("token")), "similar-index")
    forget(often)

    head = index.groupBy("token").agg(F.min(F.struct("own", "rep", "mark", "n")).alias("head"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    head = stored(head.select("token", F.col("head.mark").alias("y"), F.col("head.n").alias("n")), "similar-lists")
    near = index.join(head.select("token", "y"), "token").filter("mark != y").select(F.col("mark").alias("x"), "y").distinct()
    answers = stored(_answers(near, sets), "similar-answers")
    forget(sets)
    edges = answers.filter(_links(F.col("both"), F.col("nx") + F.col("ny"), percent)).select("a", "b")
    spent = [index, head, answers, members]
    more = stored(block_links(index, head, answers, components(edges, "similar"), percent, spent), "similar-more")
    # members of one class, and rows of one id, are linked as well
    every = edges.union(more).union(members)
    final = components(every, "similar-all")
    for done in [*spent, more]:
        forget(done)
    return sizes.join(sized(final), sizes.doc_id == final.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
