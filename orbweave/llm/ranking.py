"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is linear in the shape of its whole text (``FEATURES``). Every labelled good document is compared with every
labelled bad one, and the weights maximise the mean likelihood sigmoid(strength difference) of all these pairs, with a small ridge. The cut
between reject and keep is the quantile of the training strengths at the share of bad labels, and the score is
the sigmoid of the strength above the cut, in units of the training spread.

Training takes every label, every row of a labelled document and every pair; all documents are scored. Pairs are not written out:
each step of Newton's method adds up, by label and node of a fixed grid of strengths, the rows and their features, each row shared out
between its two neighbouring nodes, and the terms of all pairs follow from those sums by linear interpolation. Sums are made in the tasks and merged by a tree; the
driver gets tables of fixed size. Quantiles are exact order statistics of all training strengths, found by counts of ever finer cells.
Fitted numbers are rounded to ``DIGITS`` places, so that reruns agree however the tables are dealt out. ``sample`` learns from so many
labels only, those with the smallest hashes of their ids; no query sets it. Ids, languages, sources and labels are never inputs of a score.
Nulls: a null text counts as empty and is scored, as an empty one is; labels without quality or document are not used; repeated
labels count as rows, repeated documents are rows. Very long texts are counted whole. Equal scores are equal verdicts; ties of hashes
are broken by the id. Without both labels every score is 0.5. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import forget, held_out, sized, stored
from orbweave.llm.features import counts

#: Nodes of strength: ``CELLS`` for each unit near 0, wider further out, ``LAST`` on either side.
CELLS, LAST = 32, 500
NODES = np.sinh(np.arange(-LAST, LAST + 1) / CELLS)
#: Places that fitted numbers are rounded to, rows that the last step of a quantile collects, labelled rows of a task.
DIGITS, COLLECTED, TASK_ROWS = 6, 10_000, 10_000


def features() -> dict[str, Column]:
    """Shape of a text from its counts; each within a fixed range."""
    chars, words = F.greatest(F.col("n_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    share = lambda i: F.get("classes", F.lit(i)) / chars
    return {
        "length": F.log1p(F.least(F.col("n_words"), F.lit(200))),
        "upper": share(1),
        "digit": share(2),
        "mark": share(4),
        "symbol": F.sqrt(F.col("n_symbols") / words),
        "rest": share(7),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "distinct": F.col("n_distinct") / F.pow(words, F.lit(0.8)),
        "shouts": F.col("n_shouts") / words,
        "bangs": F.col("n_bangs") / words,
        "word_length": F.least(F.col("word_chars") / words, F.lit(30)),
        "common": F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x) / words,
        "line_length": F.log1p(F.least(F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)), F.lit(100))),
        "repeated_much": (100 * F.col("n_repeat_words") > 30 * F.col("n_words")).cast("double"),
        "short": (F.col("n_words") < 20).cast("double"),
    }


FEATURES = ["length", "upper", "digit", "mark", "symbol", "rest", "dup_lines", "repeats", "distinct", "shouts", "bangs", "word_length", "common", "line_length", "repeated_much", "short"]


def summed(rows: DataFrame, partial: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``partial`` (features, label, weight) over batches of rows x, good, weight; tasks' sums are merged by a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
                mine = partial(x, batch.column(1).to_numpy(), batch.column(2).to_numpy())
                total = mine if total is None else total + mine
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], names=["made"])

    made = rows.select("x", "good", "weight").mapInArrow(run, "made binary").rdd.map(lambda r: np.frombuffer(r["made"]))
    return made.treeReduce(np.add)


def steady(x: np.ndarray) -> np.ndarray:
    """x to ``DIGITS`` significant places."""
    return np.array([float(f"{v:.{DIGITS}g}") for v in x])


def strengths(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z @ w, added in one order whatever rows stand together."""
    out = np.zeros(len(z))
    for i, v in enumerate(w.tolist()):
        out += z[:, i] * v
    return out


def placed(s: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node below each strength, by label, and how far the strength is on the way to the next one."""
    lo = np.clip(np.floor(CELLS * np.arcsinh(s)), -LAST, LAST - 1).astype(np.int64) + LAST
    far = np.clip((s - NODES[lo]) / (NODES[lo + 1] - NODES[lo]), 0.0, 1.0)
    return lo + good * len(NODES), far


def newton_step(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's step from w of the mean loss of all pairs of a good and a bad row."""
    n = len(NODES)

    def by_node(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
        z = (x - mean) / spread
        at, far = placed(strengths(z, w), good)
        return np.stack([np.bincount(at, weight * (1 - far) * v, 2 * n) + np.bincount(at + 1, weight * far * v, 2 * n) for v in (1.0, *z.T)]).ravel()

    sums = summed(rows, by_node).reshape(-1, 2, n)
    (bad, good), total = sums[0], sums[1:]
    pairs = good.sum() * bad.sum()
    lost = 1 / (1 + np.exp(np.clip(NODES[:, None] - NODES, -500, 500)))  # likelihood that the bad one, along the columns, wins
    slope = (total[:, 0] @ (good @ lost) - total[:, 1] @ (lost @ bad)) / pairs + ridge * w
    doubt = lost * (1 - lost)
    share = np.concatenate([good @ doubt, doubt @ bad]) / pairs

    def outer(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
        z = (x - mean) / spread
        at, far = placed(strengths(z, w), good)
        return (z.T @ (z * (weight * ((1 - far) * share[at] + far * share[at + 1]))[:, None])).ravel()

    across = total[:, 1] @ doubt @ total[:, 0].T / pairs
    bend = summed(rows, outer).reshape(len(w), -1) - across - across.T + ridge * np.eye(len(w))
    return np.linalg.solve(bend, slope)


def fit(rows: DataFrame, ridge: float = 1e-3) -> np.ndarray | None:
    """The weight of each feature in a strength, from all rows x, good, weight (stored: they are read in each step); None without both labels."""
    k = len(FEATURES)
    found = rows.agg(F.sum(F.col("weight") * F.col("good")).alias("up"), F.sum(F.col("weight") * (1 - F.col("good"))).alias("down")).first()
    if not found["up"] or not found["down"]:
        return None
    n = found["up"] + found["down"]
    mean = steady(summed(rows, lambda x, good, weight: weight @ x) / n)
    spread = steady(np.sqrt(summed(rows, lambda x, good, weight: weight @ (x - mean) ** 2) / n) + 1e-9)
    w = np.zeros(k)
    for _ in range(30):
        now = np.round(w - newton_step(rows, mean, spread, w, ridge), DIGITS)
        moved, w = np.abs(now - w).max(), now
        if moved < 10.0 ** (1 - DIGITS):
            break
    return w / spread


def order_statistics(rows: DataFrame, ranks: list[int]) -> list[float]:
    """The values of column v of some ranks (from 0) among all rows v, weight (stored), each row as often as its weight."""
    found: dict[int, float] = {}

    def look(some: DataFrame, ranks: list[int], below: int) -> None:
        known = some.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).first()
        low, high = known["low"], known["high"]
        if high - low <= 1e-12 * max(1.0, abs(low)):
            found.update(dict.fromkeys(ranks, low))
            return
        whole = known["n"] <= COLLECTED
        cell = F.col("v") if whole else F.floor((F.col("v") - low) / ((high - low) / 1024))
        held = some.groupBy(cell.alias("cell")).agg(F.sum("weight").alias("n")).toPandas().sort_values("cell")
        ends = below + held["n"].cumsum().to_numpy()
        at = np.searchsorted(ends, ranks, "right")
        for i in np.unique(at).tolist():
            mine = [r for r, j in zip(ranks, at.tolist(), strict=True) if j == i]
            if whole:
                found.update(dict.fromkeys(mine, float(held["cell"].iloc[i])))
            else:
                look(some.filter(cell == int(held["cell"].iloc[i])), mine, int(ends[i] - held["n"].iloc[i]))

    look(rows, sorted(set(ranks)), 0)
    return [found[r] for r in ranks]


def quantile(rows: DataFrame, n: int, share: float) -> float:
    """The quantile of n values (by weight), between its two neighbours in proportion."""
    place = (n - 1) * share
    lo = min(int(place), n - 1)
    a, b = order_statistics(rows, [lo, min(lo + 1, n - 1)])
    return a + (b - a) * (place - lo)


def scored(docs: DataFrame, labels: DataFrame, sample: int | None = None, train_only: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and ``more`` string columns as they are, for each row of docs. ``train_only``: learn from
    fold rows not held out alone."""
    found = stored(counts(docs, *more), "rank-counts")
    x = found.select("doc_id", *more, held_out(F.col("doc_id")).alias("held_out"), F.array(*[c.cast("double") for c in features().values()]).alias("x"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).filter("good in (0, 1) and doc_id is not null")
    if train_only:
        marks = marks.filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id", "good").agg(F.count(F.lit(1)).alias("weight"))
    marks = stored(marks if sample is None else marks.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(sample), "rank-labels")
    joined = stored(x.join(sized(marks), "doc_id").select("x", "good", "weight"), "rank-joined")
    rows = stored(joined.coalesce(max(1, -(-joined.count() // TASK_ROWS))), "rank-labelled")  # few files: each step reads them twice
    scale = fit(rows)
    if scale is None:
        return x.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), *more)
    strength = sum((F.get("x", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(scale)), F.lit(0.0))
    trained = stored(rows.select(strength.alias("v"), "weight", "good"), "rank-strengths")
    n = trained.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * (1 - F.col("good"))).alias("bad")).first()
    cut = quantile(trained, n["n"], n["bad"] / n["n"])
    unit = quantile(trained.select(F.abs(F.col("v") - cut).alias("v"), "weight"), n["n"], 0.5) / 3 + 1e-9
    for used in (marks, joined, rows, trained):
        forget(used)
    score = F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (strength - cut) / F.lit(unit)))))
    return x.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *more)
