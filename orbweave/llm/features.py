"""Counts of every whole text that quality rules and the quality classifier share, in one pass over the bytes of a batch.

Nulls: a null text counts as empty, and an empty one has counts of 0. Very long texts are counted whole. Repeated rows are rows; ties don't
arise. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import gram_hashes, lists, LOWER, pieces, SPACE, span_hashes, text_rows, U, Words

#: Common function words of the reference languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his this are or at from have an which you had but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass kann wird sind bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec il ce plus ne se sont ou mais comme nous".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí".split(),
}
LANGUAGES = list(COMMON)
VOCABULARY = sorted({w for words in COMMON.values() for w in words})
#: Symbols of the word rules, and sentence marks.
SYMBOLS, MARKS = b"#*$%&|<>", b".,;:!?'\"()-"
CLASSES = ["lower", "upper", "digit", "space", "mark", "symbol", "beyond", "rest"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct", "n_shouts", "n_bangs"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", classes array<int>, common array<int>"

_CLASS = np.full(256, 7, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[SPACE] = 3
_CLASS[list(MARKS)] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[0xC0:] = 6  # first bytes of characters beyond ASCII
_CLASS[0x80:0xC0] = 8  # their other bytes count for nothing
_EDGE = np.zeros(256, bool)
_EDGE[list(MARKS)] = True


def _per_text(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n)


def repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where (key, owner) occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    mixed = keys ^ (owner.astype(U) + U(1)) * U(0x9FB21C651E98DF25)
    order = np.argsort(mixed)
    run = mixed[order]
    same = run[1:] == run[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = span_hashes(*_spans(VOCABULARY))
    rank = np.argsort(known)
    known = known[rank]
    for batch in batches:
        for part, column in pieces(batch):
            n = len(column)
            words = Words(column)
            h, of = words.hashes(), words.text_of()
            data, at = words.data, words.at
            text = np.repeat(np.arange(n), np.diff(at))
            classes = np.bincount(text * 9 + _CLASS[data], minlength=n * 9).reshape(n, 9)[:, :8]
            chars = classes.sum(1)

            grams = gram_hashes(h, 3)
            whole = of[: len(grams)] == of[2:] if len(grams) else np.zeros(0, bool)
            twice = np.zeros(len(grams), bool)
            twice[whole] = repeated(grams[whole], of[: len(grams)][whole])
            covered = np.zeros(len(h), bool)
            for j in range(3):
                covered[j : j + len(grams)] |= twice

            # lines, split at \n; a line with a word is a repeat if an earlier line of the text has the same bytes
            first = np.union1d(at[:-1], np.flatnonzero(data == 10) + 1)
            first = first[first < len(data)]
            last = np.append(first[1:], len(data))
            line_of = np.searchsorted(at, first, "right") - 1
            last = np.where((last > first) & (data[last - 1] == 10) & (last > 0), last - 1, last)
            seen = np.searchsorted(words.start, last) > np.searchsorted(words.start, first)
            first, last, line_of = first[seen], last[seen], line_of[seen]
            key = span_hashes(data, first, last) ^ (line_of.astype(U) + U(1)) * U(0x9FB21C651E98DF25)
            new = np.unique(key, return_index=True)[1]
            fresh = np.zeros(len(key), bool)
            fresh[new] = True  # one of each; how many are left over is what counts
            dups = _per_text(line_of[~fresh], n)

            low = LOWER[data]
            start, end = words.start.copy(), words.end.copy()
            for _ in range(2):  # words without the marks around them
                move = (end - start > 1) & _EDGE[data[np.minimum(start, max(len(data) - 1, 0))]] if len(start) else np.zeros(0, bool)
                start[move] += 1
                move = (end - start > 1) & _EDGE[data[end - 1]] if len(start) else np.zeros(0, bool)
                end[move] -= 1
            bare = span_hashes(low, start, end)
            near = np.minimum(np.searchsorted(known, bare), len(known) - 1)
            hit = known[near] == bare
            common = np.bincount(of[hit] * len(known) + rank[near[hit]], minlength=n * len(known)).reshape(n, len(known))

            upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
            shouts = (upper[words.end] - upper[words.start] >= 2) if len(h) else np.zeros(0, bool)
            distinct = np.unique(h ^ (of.astype(U) + U(1)) * U(0x9FB21C651E98DF25), return_index=True)[1]
            columns = {
                "n_words": np.diff(words.first),
                "word_chars": chars - classes[:, 3],
                "n_symbols": classes[:, 5],
                "n_dup_lines": dups,
                "n_repeat_words": _per_text(of[covered], n),
                "n_chars": chars,
                "n_lines": _per_text(line_of, n),
                "n_distinct": _per_text(of[distinct], n),
                "n_shouts": _per_text(of[shouts], n),
                "n_bangs": np.bincount(text[data == ord("!")], minlength=n),
            }
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(columns[c], pa.int64()) for c in COUNTS], lists(classes.ravel(), np.full(n, 8), pa.int32()), lists(common.ravel(), np.full(n, len(known)), pa.int32()), *part.columns[2:]],
                names=["doc_id", *COUNTS, "classes", "common", *part.schema.names[2:]],
            )


def _spans(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    coded = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in coded])
    return np.frombuffer(b"".join(coded), np.uint8), end - [len(w) for w in coded], end


def counts(docs: DataFrame, *more: str) -> DataFrame:
    """One row of ``SCHEMA``, and of ``more`` string columns, for each row of docs. A null text counts as empty."""
    rows = text_rows(docs, *more)
    return rows.mapInArrow(_counts, ", ".join([SCHEMA, *[f"{c} string" for c in more]]))
