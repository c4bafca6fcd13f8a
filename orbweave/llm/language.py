"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; runs of letters, with a border mark around each, give n-grams of 1 to 3 characters, hashed
to ``DIMS`` features weighted (1 + ln tf) * idf and scaled to length 1. The model is trained with the
follow-the-regularised-leader proximal update per coordinate, which carries the elastic net (``l1`` gives exact zeros), then one
temperature is fitted on a part kept from training.

Document frequencies come from all training rows, summed before they reach the driver (``DIMS`` numbers). The classes are
the languages of all training rows with a letter. Of each the regression takes its part of ``SAMPLE`` rows, and up to
``FEW`` where that is less: those with the smallest hashes of id and text, equal rows once. So at most
2 * ``SAMPLE`` rows and one a language reach the driver; all rows are predicted, from their whole texts.
The rows that are learned are ordered by language and hash before the seeded draw, so reruns agree however the table is dealt out.
Nulls: rows without language, or with a null id in another fold, aren't learned; a null text, an empty one, or one without a letter, is
``und`` with score 0; without any labelled row all rows are ``und``. Very long texts are counted whole; equal scores go to the first
language by name. Repeated rows are rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import held_out, lists, text_rows

DIMS, SAMPLE, FEW, MAX_CLASSES = 1 << 12, 4000, 50, 500
#: Some text with a letter, or with a character that the JVM doesn't know yet and Python may.
_LETTER = r"[\p{L}\p{Cn}]"
_KINDS = None


def kinds() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what isn't a letter (computed once for the basic plane)."""
    global _KINDS
    if _KINDS is None:
        table = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _KINDS = table
    return _KINDS


def letters(text: str) -> np.ndarray:
    """Lower-case code points; 0 for each character that isn't a letter. A text starts and ends with 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + 2, np.uint32)
    low = points < 1 << 16
    if low.all():
        out[1:-1] = kinds()[points]
    else:
        out[1:-1] = np.where(low, kinds()[np.where(low, points, 0)], [ord(c.lower()[0]) if c.isalpha() else 0 for c in text])
    return out


def term_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if there is no letter."""
    x = letters(text)
    if not x.any():
        return None
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)  # one mark between runs
    x = x[keep].astype(np.uint32)
    counts = np.bincount((x * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMS)
    two = (x[:-1] * np.uint32(0x85EBCA77) ^ x[1:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    counts += np.bincount(two >> np.uint32(20), minlength=DIMS)
    three = (two[:-1] ^ x[2:] * np.uint32(0x165667B1)) * np.uint32(0x9E3779B1)
    return counts + np.bincount(three >> np.uint32(20), minlength=DIMS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            yield part, pc.fill_null(part.column(1), "").to_pylist()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for _, texts in _texts(batches):
        for text in texts:
            if (c := term_counts(text)) is not None:
                df += c > 0
                n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(np.append(df, n))], names=["term", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches):
        terms, counts, sizes = [], [], []
        for text in texts:
            c = term_counts(text)
            at = np.flatnonzero(c) if c is not None else np.empty(0, np.int64)
            terms.append(at)
            counts.append(c[at] if c is not None else at)
            sizes.append(len(at))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), lists(np.concatenate(terms), np.array(sizes), pa.int32()), lists(np.concatenate(counts), np.array(sizes), pa.int32())],
            names=["doc_id", "lang", "terms", "counts"],
        )


class Model:
    """FTRL-proximal multinomial regression with a temperature."""

    def __init__(self, classes: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.classes, self.idf = classes, idf
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((DIMS + 1, len(classes)))
        self.n = np.zeros_like(self.z)
        self.temperature = 1.0

    def row(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(counts)) * self.idf[terms]
        v = v / max(np.linalg.norm(v), 1e-12)
        return np.append(terms, DIMS), np.append(v, 1.0)  # the last is the intercept

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[y] -= 1
        g = v[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        tries = np.exp(np.linspace(-2.5, 2.5, 101))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tries]
        self.temperature = float(tries[int(np.argmin(loss))])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple], df: np.ndarray, n_docs: int, epochs: int = 3, seed: int = 17) -> Model:
    """rows: (lang, terms, counts)."""
    classes = sorted({r[0] for r in rows})
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages")
    model = Model(classes, np.log((1 + n_docs) / (1 + df)) + 1)
    data = [(*model.row(np.array(t, np.int64), np.array(c, float)), classes.index(name)) for name, t, c in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept = learn = order
    if len(data) >= 50:
        _, first = np.unique([data[i][2] for i in order], return_index=True)
        order = np.append(np.delete(order, first), order[first])  # a row of each class is learned
        cut = min(len(data) // 5, len(data) - len(first)) or len(data)
        kept, learn = order[:cut], order[cut:] if cut < len(data) else order
    for _ in range(epochs):
        for i in rng.permutation(learn):
            model.step(*data[i])
    w = model.weights()
    model.calibrate(np.array([data[i][1] @ w[data[i][0]] for i in kept]), np.array([data[i][2] for i in kept]))
    return model


def _predicted(batches: Iterator[pa.RecordBatch], classes: list[str], idf: np.ndarray, w: np.ndarray, temperature: float) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches):
        names, scores = [], []
        x = np.zeros((len(texts), DIMS), np.float32)
        known = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            c = term_counts(text)
            if c is not None:
                known[i] = True
                at = np.flatnonzero(c)
                x[i, at] = (1 + np.log(c[at])) * idf[at]
        if classes:
            x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
            p = softmax((x @ w[:-1] + w[-1]) / temperature)
            best = p.argmax(1)
        for i in range(len(texts)):
            ok = known[i] and classes
            names.append(classes[best[i]] if ok else "und")
            scores.append(float(p[i, best[i]]) if ok else 0.0)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])


def chosen(learn: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """h, text, lang of the rows to learn from: of each language those with the smallest hashes h of id and text."""
    named = learn.filter(F.col("text").rlike(_LETTER)).withColumn("h", F.xxhash64("doc_id", "text"))
    counts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("different")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages")
    n, few = sum(r["n"] for r in counts), max(1, min(FEW, sample // max(len(counts), 1)))
    places = {r["lang"]: max(few, -(-sample * r["n"] // n)) for r in counts}
    # hashes are uniform: twice the places below a first cut, so that few come to the driver
    share = [(r["lang"], (2 * places[r["lang"]] + 64) / max(r["different"], 1)) for r in counts]
    cuts = [(lang, (1 << 63) - 1 if x >= 1 else int(x * (1 << 64)) - (1 << 63)) for lang, x in share]
    below = lambda rows: named.join(F.broadcast(learn.sparkSession.createDataFrame(rows, "lang string, most long")), "lang").filter("h <= most")
    found: dict[str, list[int]] = {}
    for r in below(cuts).select("lang", "h").distinct().collect():
        found.setdefault(r["lang"], []).append(r["h"])
    last = [(lang, sorted(h)[: places[lang]][-1]) for lang, h in found.items()]
    return below(last).groupBy("lang", "h").agg(F.min("text").alias("text")).select("h", "text", "lang")


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs, learned from its rows that aren't held out."""
    rows = text_rows(docs, "lang")
    learn = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df = np.zeros(DIMS + 1, np.int64)
    for row in learn.mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row["term"]] = row["n"]
    few = chosen(learn, sample).mapInArrow(_sparse, "doc_id long, lang string, terms array<int>, counts array<int>").toArrow()
    few = few.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    got = [(lang.as_py(), t.values.to_numpy(), c.values.to_numpy()) for lang, t, c in zip(few["lang"], few["terms"], few["counts"], strict=True) if len(t)]
    if got:
        model = train(got, df[:DIMS], int(df[DIMS]))
        settings = model.classes, model.idf.astype(np.float32), model.weights().astype(np.float32), model.temperature
    else:
        settings = [], np.zeros(DIMS), np.zeros((DIMS + 1, 1)), 1.0
    marked = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return marked.mapInArrow(lambda batches: _predicted(batches, *settings), "doc_id long, held_out boolean, lang_pred string, score double")
