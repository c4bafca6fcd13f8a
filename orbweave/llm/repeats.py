"""Substring deduplication by recompression.

Words are named by hash. A round gives one symbol to every run of a symbol and to every pair of a left and a right symbol (sides
are salted bits of the names). A name is a hash of its parts and of nothing else, so equal stretches of words get equal symbols in all
documents without an exchange, but for symbols at their ends; Spark's rounds keep the tables of the names that several
documents share, and only what they keep goes on:

1. Reveal. After ``ROUNDS`` rounds of pairs (which reach 2**rounds - 1 words at most beyond a symbol; runs, whose reach has no bound,
   stay as they are here), groups of ``GROUP`` symbols are named, and of every stretch of as many groups as each window has within
   the smallest is kept. Shared names say which windows can repeat; a stretch whose name is in one document only rules its windows out.
2. Rise. In the words of these windows rounds of runs and pairs go on, up to ``RISE``. Symbols of ``window`` words and more are
   counted with their parts: one that a smaller document has too proves a repeat of all its words. A name with more than one
   pair of parts proves nothing.
3. Rest. Windows that no such symbol decides, those over the ends of symbols, are named by their words and compared one by one.

A window in no smaller document is never decided by a symbol, so the smallest document of each window always takes part in the last
step, and the result is exact up to equality of 64-bit hashes. All counts are minima by key, without pairs of documents.

Nulls: a null text has no words, as an empty one has; a null id is compared with nothing. Rows are told apart by id and text; rows of one
id never remove each other's words. Very long texts are worked on whole, each in one task. Ties don't arise, as ids are compared
strictly. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import _mixed, forget, gram_hashes, gram_hashes_at, lists, pieces, signed, sized, stored, text_rows, U, Words

ROUNDS, GROUP, RISE = 2, 4, 32
_SALT = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)]


def parsed(h: np.ndarray, text_of: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after the rounds and the word each starts at. Neighbours in different texts never pair."""
    name, at = h.copy(), np.arange(len(h))
    for r in range(rounds):
        if len(name) < 2:
            break
        right = (_mixed(name ^ _SALT[r % len(_SALT)]) & U(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & (text_of[at[:-1]] == text_of[at[1:]])
        name[:-1][pair] = _mixed(name[:-1][pair] * U(0x9E3779B97F4A7C15) + name[1:][pair] + U(r + 1))
        keep = np.ones(len(name), bool)
        keep[1:][pair] = False
        name, at = name[keep], at[keep]
    return name, at


def climbed(h: np.ndarray, stretch: np.ndarray, least: int, rounds: int = RISE) -> tuple[np.ndarray, ...]:
    """The symbols of at least ``least`` words that rounds of runs and pairs make within stretches: name, first word, end, parts.

    The parts of a pair are its two symbols, those of a run its symbol and how often it stands there.
    """
    name, at, out = h.copy(), np.arange(len(h) + 1), []

    def note(new: np.ndarray, first: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        long = end - first >= least
        out.append((new[long], first[long], end[long], left[long], right[long]))

    for r in range(rounds):
        if len(name) < 2:
            break
        joint = stretch[at[1:-1]] == stretch[at[:-2]]
        same = joint & (name[1:] == name[:-1])
        if same.any():
            first = np.flatnonzero(np.append(True, ~same))
            n = np.diff(np.append(first, len(name)))
            part, at = name[first], np.append(at[first], at[-1])
            run = n > 1
            name = part.copy()
            name[run] = _mixed(part[run] * U(0xC2B2AE3D27D4EB4F) + n[run].astype(U) * U(0x9E3779B97F4A7C15) + U(0x5E))
            note(name[run], at[:-1][run], at[1:][run], part[run], n[run].astype(U))
            joint = stretch[at[1:-1]] == stretch[at[:-2]]
        right = (_mixed(name ^ (_SALT[r % len(_SALT)] + U(r))) & U(1)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & joint)
        left, second = name[pair], name[pair + 1]
        name[pair] = _mixed(left * U(0x9E3779B97F4A7C15) + second + U(r + 1))
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        note(name[pair], at[pair], at[pair + 2], left, second)
        name, at = name[keep], np.append(at[:-1][keep], at[-1])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (h[:0], *[np.empty(0, np.int64)] * 2, h[:0], h[:0])


def reach(window: int, rounds: int) -> int:
    """How many groups of symbols every window has within, whatever surrounds it."""
    return (window - 2 * (2**rounds - 1)) // 2**rounds - GROUP + 1


def winners(h: np.ndarray, w: int) -> np.ndarray:
    """The leftmost smallest member of every w consecutive ones, by first member."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(n)
    low = h[:n].copy()
    for j in range(1, w):
        other = h[j : j + n]
        less = other < low
        low[less] = other[less]
        best[less] = np.flatnonzero(less) + j
    return best


def symbols(h: np.ndarray, text_of: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and ends (words) of the high-level symbols of the texts of a piece; then, of every stretch of
    ``reach`` groups within a text, the number of its symbol, and the first word and the end of the stretch (two rows)."""
    w = reach(window, rounds)
    name, at = parsed(h, text_of, rounds)
    groups = gram_hashes(name, GROUP)
    best = winners(groups, w)
    edge = np.append(at, len(h))
    stretch = np.stack([edge[: len(best)], edge[w - 1 + GROUP : w - 1 + GROUP + len(best)]]) if len(best) else np.zeros((2, 0), np.int64)
    whole = text_of[stretch[0]] == text_of[stretch[1] - 1] if len(best) else np.zeros(0, bool)
    best, stretch = best[whole], stretch[:, whole]
    chosen, number = np.unique(best, return_inverse=True)
    return groups[chosen], at[chosen], edge[chosen + GROUP], number, stretch


def _anchors(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Each text's distinct high-level symbols."""
    for batch in batches:
        for part, column in pieces(batch):
            words = Words(column)
            h, of = words.hashes(), words.text_of()
            name, at, *_ = symbols(h, of, window, rounds)
            owner = of[at]
            order = np.lexsort((name, owner)) if len(name) else np.empty(0, np.int64)
            name, owner = name[order], owner[order]
            if len(name):
                first = np.ones(len(name), bool)
                first[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
                name, owner = name[first], owner[first]
            counts = np.bincount(owner, minlength=len(column))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists(signed(name), counts, pa.int64())], names=["doc_id", "row", "symbols"])


def _windows_over(first: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words start a window, within words low to high, that holds one of the spans first to end."""
    change = np.zeros(n + 1, np.int64)
    a, b = np.maximum(end - window, low), np.minimum(first, high - window)
    ok = a <= b
    np.add.at(change, a[ok], 1)
    np.add.at(change, b[ok] + 1, -1)
    return np.cumsum(change)[:-1] > 0


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The members of ranges of n whole numbers from each first one."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def ranges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as ranges: the first of each, and how many follow each other."""
    cut = np.flatnonzero(np.append(True, np.diff(x) > 1)) if len(x) else x
    return x[cut], np.diff(np.append(cut, len(x)))


def _candidates(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Of doc_id, row, text, symbols (those it shares): the windows that can repeat, as ranges (first, n), the names of the words
    in them, one after the other, and their symbols of at least ``window`` words."""
    for batch in batches:
        for part, column in pieces(batch):
            words = Words(column)
            h, of = words.hashes(), words.text_of()
            name, at, end, number, stretch = symbols(h, of, window, rounds)
            starts = words.first
            bounds = np.searchsorted(at, starts)
            shared = part.column(part.schema.get_field_index("symbols"))
            known = np.zeros(len(at), bool)
            for t in range(len(column)):
                a, b = bounds[t], bounds[t + 1]
                if b > a:
                    known[a:b] = np.isin(signed(name[a:b]), shared[t].values.to_numpy())
            text = of[at]
            near = _windows_over(at[known], end[known], starts[text[known]], starts[text[known] + 1], window, len(h))
            # a stretch whose symbol no other document has rules out the windows that parse it the same everywhere
            loose = 2**rounds - 1
            alone = stretch[:, ~known[number]] if len(at) else stretch
            text = of[alone[0]]
            out = _windows_over(alone[0] - loose, alone[1] + loose, starts[text], starts[text + 1], window, len(h))
            chosen = np.flatnonzero(near & ~out)
            change = np.zeros(len(h) + 1, np.int64)
            np.add.at(change, chosen, 1)
            np.add.at(change, chosen + window, -1)
            alive = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            own = of[alive]
            apart = np.append(True, (np.diff(alive) > 1) | (own[1:] != own[:-1]))[: len(alive)]
            high, first, last, left, right = climbed(h[alive], np.cumsum(apart), window)
            where = own[first]
            order = np.argsort(where, kind="stable")
            where, first, last = where[order], alive[first[order]], alive[last[order] - 1] + 1
            place = lambda x, t: pa.array(x - starts[t], pa.int32())
            texts = np.arange(len(column) + 1)
            low, n = ranges(chosen + of[chosen])  # a gap of one between the windows of two texts
            low = low - of[chosen[np.cumsum(n) - n]] if len(n) else low
            offsets = lambda owner: pa.array(np.searchsorted(owner, texts), pa.int32())
            listed = lambda owner, values: pa.ListArray.from_arrays(offsets(owner), values)
            parts = pa.StructArray.from_arrays(
                [pa.array(signed(high[order])), place(first, where), pa.array(last - first, pa.int32()), pa.array(signed(left[order])), pa.array(signed(right[order]))],
                names=["name", "first", "n", "left", "right"],
            )
            windows = pa.StructArray.from_arrays([place(low, of[low]) if len(low) else pa.array([], pa.int32()), pa.array(n, pa.int32())], names=["first", "n"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), listed(of[low] if len(low) else low, windows), listed(own, pa.array(signed(h[alive]))), listed(where, parts)],
                names=["doc_id", "row", "windows", "words", "parts"],
            )


_CANDIDATES = "doc_id long, row long, windows array<struct<first:int,n:int>>, words array<long>, parts array<struct<name:long,first:int,n:int,left:long,right:long>>"


def _rest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The names of the windows that no symbol decides, of doc_id, row, windows, words, decided (spans)."""
    for batch in batches:
        keys, starts, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
        for low, words, done in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            first, n = (low.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            h = words.values.to_numpy().view(np.uint64)
            alive = spread(*_united(first, n + window - 1))
            chosen = spread(first, n)
            if done.is_valid:
                a, m = unpacked(done.values.to_numpy())
                change = np.zeros(int(max(chosen.max(initial=0), a.max(initial=0))) + 2, np.int64)
                np.add.at(change, a, 1)
                np.add.at(change, np.minimum(a + m - window + 1, len(change) - 1), -1)
                chosen = chosen[np.cumsum(change)[chosen] <= 0]
            keys.append(gram_hashes_at(h, np.searchsorted(alive, chosen), window))
            starts.append(chosen)
            sizes.append(len(chosen))
        owner = pa.array(np.repeat(np.arange(len(batch)), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate(starts), pa.int32())], names=["key", "doc_id", "row", "start"])


def _united(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in ascending order with those that meet or overlap made one."""
    end = np.maximum.accumulate(first + n) if len(n) else n
    cut = np.flatnonzero(np.append(True, first[1:] > end[:-1])[: len(n)])
    return first[cut], end[np.append(cut[1:], len(n))[: len(cut)] - 1] - first[cut]


def packed(first: Column, n: Column) -> Column:
    """A span of words as one number."""
    return F.shiftleft(first.cast("long"), 32) + n


def unpacked(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans >> 32, spans & 0xFFFFFFFF


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, column in pieces(batch):
            words = Words(column)
            drop = part.column(part.schema.get_field_index("spans"))
            counts, removed, digest, texts = np.diff(words.first), [], [], []
            raw = words.data.tobytes()
            for t in range(len(column)):
                lo, hi = words.first[t], words.first[t + 1]
                n = int(hi - lo)
                gone = np.zeros(n + 1, np.int64)
                if drop[t].is_valid:
                    first, m = unpacked(drop[t].values.to_numpy())
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + m, -1)
                stay = np.cumsum(gone[:-1]) == 0
                removed.append(int(n - stay.sum()))
                a, b = words.start[lo:hi][stay].tolist(), words.end[lo:hi][stay].tolist()
                kept = b" ".join([raw[i:j] for i, j in zip(a, b, strict=True)])
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _shared(places: DataFrame, name: str) -> DataFrame:
    """The table of the names that occur in two documents, with the smallest of them."""
    return places.groupBy(name).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")


def without_repeats(docs: DataFrame, window: int = 50, rounds: int = ROUNDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row of docs."""
    if reach(window, rounds) < 1:
        raise ValueError("a window has to hold an interior symbol: fewer rounds or a longer window")
    rows = text_rows(docs).withColumn("row", F.xxhash64("text"))
    known, of_row = rows.filter("doc_id is not null and text is not null"), ["doc_id", "row"]

    # reveal; tables that join their own input are stored first, so that both sides are exchanged and a hot name can be split
    anchors = stored(known.mapInArrow(lambda batches: _anchors(batches, window, rounds), "doc_id long, row long, symbols array<long>"), "repeats-anchors")
    places = anchors.select(*of_row, F.explode("symbols").alias("symbol"))
    shared = stored(_shared(places, "symbol").select("symbol"), "repeats-symbols")
    hits = stored(places.join(shared, "symbol").groupBy(*of_row).agg(F.collect_set("symbol").alias("symbols")), "repeats-shared")
    forget(anchors)
    forget(shared)
    chosen = known.join(sized(hits, hits.count() * 100), of_row).select(*of_row, "text", "symbols")  # rows of about 100 symbols
    found = stored(chosen.mapInArrow(lambda batches: _candidates(batches, window, rounds), _CANDIDATES), "repeats-candidates")
    forget(hits)

    # rise
    parts = found.select(*of_row, F.explode("parts").alias("p")).select(*of_row, "p.*")
    least = parts.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("left", "right", "n") for f in (F.min, F.max)])
    least = stored(least.filter("least < most and min_left = max_left and min_right = max_right and min_n = max_n").select("name", "least"), "repeats-names")
    decided = parts.join(least, "name").filter("doc_id > least").select(*of_row, packed(F.col("first"), F.col("n")).alias("span"))
    decided = stored(decided.groupBy(*of_row).agg(F.collect_set("span").alias("decided")), "repeats-decided")
    forget(least)

    # rest
    rest = found.select(*of_row, "windows", "words").join(sized(decided, decided.count() * 10), of_row, "left").select(*of_row, "windows", "words", "decided")
    windows = stored(rest.mapInArrow(lambda batches: _rest(batches, window), "key long, doc_id long, row long, start int"), "repeats-windows")
    forget(found)
    least = stored(_shared(windows, "key").select("key", "least"), "repeats-least")
    later = windows.join(least, "key").filter("doc_id > least").select(*of_row, packed(F.col("start"), F.lit(window)).alias("span"))
    spans = later.union(decided.select(*of_row, F.explode("decided").alias("span")))
    drops = stored(spans.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("of")).agg(F.collect_set("span").alias("spans")), "repeats-drops")
    for done in (windows, least, decided):
        forget(done)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    joined = rows.join(sized(drops, drops.count() * 100), (rows.doc_id == drops.id) & (rows.row == drops.of), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda batches: _kept(batches, with_text), schema)
