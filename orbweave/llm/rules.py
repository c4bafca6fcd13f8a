"""Quality rules: word rules, then the Jensen-Shannon distance of a document to language references.

References come from the corpus: a document speaks a language if at least ``floor`` of its words are common words of it, and a
language's reference is the summed histogram (character classes; its common words, and all other words as one) of the documents
that speak it most and pass the word rules. A document is compared with the references of the languages it speaks and the nearest counts; what is
allowed grows for short texts by ``slack`` over the root of their words. Guards:
texts are compared from ``min_words`` words on; a language counts as a reference from ``min_docs`` documents on; a document that
speaks languages without a reference keeps to the word rules. A document that speaks none of the languages is compared by its character
classes with running text of any language (``PROSE``, letters as one class), and a text of another script (more than half of its characters
beyond ASCII) not at all. So which rows of other languages a table has changes nothing for a document: its text decides what it is measured by.

The limits lie above the distances of 99.9 % of the labelled good documents of the learning fold (crc32 of the id mod 3 not 1) at scale
0.1; tests look at the other fold. They aren't learned from labels at run time.

The counts of each document are stored once; the references are a handful of rows.
Nulls: a null text has no words (it fails the word rules), as an empty one has; very long texts are counted whole. A text with as many
common words of two languages counts towards the first of en, de, fr, es. Repeated rows are rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import stored
from orbweave.llm.features import CLASSES, COMMON, LANGUAGES, VOCABULARY, counts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Places of each language's common words in the counts.
PLACES = {x: np.array([VOCABULARY.index(w) for w in COMMON[x]]) for x in LANGUAGES}
SPACE, BEYOND = CLASSES.index("space"), CLASSES.index("beyond")
LETTERS = [CLASSES.index(c) for c in ("lower", "upper", "beyond")]
OTHERS = [i for i in range(len(CLASSES)) if i not in LETTERS]
#: Shares of letters, then of the other classes (digits, spaces, marks, symbols, the rest), in running text.
PROSE = np.array([0.81, 0.002, 0.164, 0.024, 0.0, 0.0])
#: Least share of a language's common words in a text that speaks it.
FLOOR = 0.12


class Counted:
    """Counts of a batch as arrays, the word rules, the languages each text speaks, and the one it has most common words of."""

    def __init__(self, batch: pa.RecordBatch, floor: float):
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        self.base = {c: col(c).to_numpy() for c in BASE}
        self.words = self.base["n_words"]
        self.classes = col("classes").flatten().to_numpy().reshape(len(batch), len(CLASSES))
        self.common = col("common").flatten().to_numpy().reshape(len(batch), len(VOCABULARY))
        self.failed = (self.words < 50) | (100 * self.base["n_repeat_words"] > 50 * self.words)
        hits = np.stack([self.common[:, PLACES[x]].sum(1) for x in LANGUAGES], 1)
        self.language = hits.argmax(1)
        self.speaks = hits >= np.maximum(floor * self.words, 1)[:, None]
        self.beyond = self.classes[:, BEYOND] / np.maximum(self.classes.sum(1) - self.classes[:, SPACE], 1)

    def letters(self) -> np.ndarray:
        """Counts of letters and of the other classes."""
        return np.concatenate([self.classes[:, LETTERS].sum(1, keepdims=True), self.classes[:, OTHERS]], 1)

    def words_of(self, language: str) -> np.ndarray:
        """Counts of a language's common words and of all other words."""
        own = self.common[:, PLACES[language]]
        return np.concatenate([own, np.maximum(self.words - own.sum(1), 0)[:, None]], 1)


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) of rows of counts to a distribution; NaN for rows without counts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / counts.sum(1, keepdims=True)
        m = (p + reference) / 2
        term = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0)
        both = (term(p) + term(np.broadcast_to(reference, p.shape))).sum(1) / 2
    return np.where(counts.sum(1) > 0, np.sqrt(np.maximum(both, 0)), np.nan)


def _reference_sums(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Sums of documents, character classes and words by language: place, n."""
    sums = {x: np.zeros(1 + len(CLASSES) + len(COMMON[x]) + 1, np.int64) for x in LANGUAGES}
    for batch in batches:
        found = Counted(batch, floor)
        for i, x in enumerate(LANGUAGES):
            mine = ~found.failed & found.speaks[:, i] & (found.language == i)
            sums[x] += np.concatenate([[mine.sum()], found.classes[mine].sum(0), found.words_of(x)[mine].sum(0)]).astype(np.int64)
    for x, n in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(n)), pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], names=["language", "place", "n"])


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, language string, char_distance double, word_distance double, kept boolean"


def _judged(batches: Iterator[pa.RecordBatch], references: dict, limits: tuple, min_words: int, floor: float) -> Iterator[pa.RecordBatch]:
    max_chars, max_words, chars_slack, words_slack = limits
    for batch in batches:
        found = Counted(batch, floor)
        by_chars, by_words = np.full(len(batch), np.nan), np.full(len(batch), np.nan)
        for x, (chars, words) in references.items():
            speaks = found.speaks[:, LANGUAGES.index(x)]
            by_chars = np.fmin(by_chars, np.where(speaks, distances(found.classes, chars), np.nan))
            by_words = np.fmin(by_words, np.where(speaks, distances(found.words_of(x), words), np.nan))
        silent = ~found.speaks.any(1) & (found.beyond <= 0.5)
        by_chars = np.where(silent, distances(found.letters(), PROSE / PROSE.sum()), by_chars)
        few = found.words < min_words
        by_chars[few] = by_words[few] = np.nan
        short = 1 / np.sqrt(np.maximum(found.words, 1))  # a sample's distance to its own source falls as this
        far = (by_chars > max_chars + chars_slack * short) | (by_words > max_words + words_slack * short)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(found.base[c]) for c in BASE], pa.array(found.failed), pa.array([LANGUAGES[i] if n else None for i, n in zip(found.language, found.speaks.any(1), strict=True)], pa.string()), pa.array(by_chars, from_pandas=True), pa.array(by_words, from_pandas=True), pa.array(~found.failed & ~far)],
            names=["doc_id", *BASE, "base_failed", "language", "char_distance", "word_distance", "kept"],
        )


def judged(docs: DataFrame, max_chars: float = 0.18, max_words: float = 0.25, chars_slack: float = 0.6, words_slack: float = 0.7, min_words: int = 50, min_docs: int = 20, floor: float = FLOOR) -> DataFrame:
    """doc_id, the counts, base_failed, language, char_distance, word_distance, kept."""
    found = stored(counts(docs).select("doc_id", *BASE, "classes", "common"), "rules-counts")
    sums: dict[str, dict] = {}
    for row in found.mapInArrow(lambda batches: _reference_sums(batches, floor), "language string, place int, n long").groupBy("language", "place").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(row["language"], {})[row["place"]] = row["n"]  # a fixed number of rows for each language
    references = {}
    for x, n in sorted(sums.items()):
        line = np.array([n[i] for i in range(len(n))], float)
        if line[0] >= min_docs:
            chars, words = line[1 : 1 + len(CLASSES)], line[1 + len(CLASSES) :]
            references[x] = chars / chars.sum(), words / words.sum()
    limits = max_chars, max_words, chars_slack, words_slack
    return found.mapInArrow(lambda batches: _judged(batches, references, limits, min_words, floor), SCHEMA)
