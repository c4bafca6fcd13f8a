"""Benchmark decontamination by winnowing.

An item's windows are its runs of ``window`` consecutive words (an item of n < ``window`` words is one window of n words).
Of every run of n - k + 1 hashes of k words (of n words where n < k) the smallest is a fingerprint, so each shared window has a
shared fingerprint. Spark does the matching, each step a join of tables:

1. Items become a table of windows (length, 64-bit hash, item) and a table of fingerprints.
2. Each text's distinct fingerprints are computed once, stored, and joined with those of the items. A bitmap of ``BITS`` bits of the
   items' fingerprints (1 MB, whatever their number) leaves most of the others out of the table before the join decides.
3. Texts with a common fingerprint are extended: every window of theirs over such a fingerprint is hashed and joined with
   the items' windows by length and hash. Windows decide, fingerprints only say where to look.
4. What is found is gathered by text and given to all rows of that text.

Results depend on the text alone, so texts are told apart by their MD5 digests and rows of one id or of none are never mixed. An
item side of at most ``BROADCAST_ROWS`` counted rows is broadcast; beyond it the same joins shuffle both sides, which are
stored tables, so that a hot fingerprint can be split. Neither items nor documents pass through the driver.

Nulls: a null text has no words; a null doc_id is a row like others; a null item_id is one item without a name, counted but not
listed. Equal item_ids are one item with the windows of all its rows; item_ids of any type are used as strings. Repeated rows are rows;
ties don't arise. Empty texts hit nothing and very long texts are worked on whole, each in one task. An empty benchmark hits
nothing, an empty table of documents gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import forget, gram_hashes, gram_hashes_at, lists, NOT_ALNUM, pieces, signed, sized, stored, text_rows, Words


#: Bits of the filter of the items' fingerprints.
BITS = 1 << 23


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest (leftmost if equal) of every w consecutive hashes."""
    if len(h) < w:
        return np.empty(0, np.int64)
    low, have = h, 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    chosen = np.zeros(len(h), bool)
    left = np.ones(len(low), bool)  # windows whose smallest isn't found yet
    for j in range(w):
        hit = left & (h[j : j + len(low)] == low)
        chosen[j : j + len(low)] |= hit
        left &= ~hit
    return np.flatnonzero(chosen)


def fingerprints(h: np.ndarray, text_of: np.ndarray, lengths: list[int], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For windows of each length: the words of a fingerprint, their first words, and the hashes. Those across texts are left out."""
    for n in lengths:
        own = min(k, n)
        grams = gram_hashes(h, own)
        at = winnowed(grams, n - own + 1)
        at = at[text_of[at] == text_of[at + own - 1]] if len(at) else at
        yield n, at, grams[at]


def distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) without repeats, by owner."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


def bitmap(prints: DataFrame) -> np.ndarray:
    """The filter: bit i of byte j is set if some fingerprint ends in the bits of 8 j + i. Spark's bitmaps have 4096 bytes."""
    place = F.col("print").bitwiseAND(BITS - 1) + 1
    parts = prints.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():  # at most 256 rows
        lo = 4096 * (r["part"] - 1)
        out[lo : lo + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """False for fingerprints that no item has."""
    place = (prints & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _items(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each item's window length, its windows and its fingerprints."""
    for batch in batches:
        for part, column in pieces(batch):
            words = Words(column, NOT_ALNUM, lower=True)
            h = words.hashes()
            lengths, keys, prints = [], [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                n, own = min(b - a, window), h[a:b]
                lengths.append(n)
                keys.append(np.unique(gram_hashes(own, n)) if n else own)
                found = [x for _, _, x in fingerprints(own, np.zeros(b - a, np.int64), [n], k)] if n else [own]
                prints.append(np.unique(found[0]))
            count = lambda xs: np.array([len(x) for x in xs], np.int64)
            join = lambda xs: signed(np.concatenate(xs))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lengths, pa.int32()), lists(join(keys), count(keys), pa.int64()), lists(join(prints), count(prints), pa.int64())],
                names=["item", "n", "keys", "prints"],
            )


def _prints(batches: Iterator[pa.RecordBatch], lengths: list[int], k: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, number of words and distinct fingerprints (those that pass the filter) of each text."""
    for batch in batches:
        for part, column in pieces(batch):
            words = Words(column, NOT_ALNUM, lower=True)
            h, of = words.hashes(), words.text_of()
            by_gram: dict[int, list] = {}
            for n, at, _ in fingerprints(h, of, lengths, k):
                by_gram.setdefault(min(n, k), []).append(at)
            owner, value = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for own, found in by_gram.items():
                at = np.unique(np.concatenate(found))
                prints = gram_hashes(h, own)[at]
                some = maybe(bits, prints)
                owner.append(of[at[some]])
                value.append(prints[some])
            owner, value = distinct(np.concatenate(owner), np.concatenate(value))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(words.first), pa.int64()), lists(signed(value), np.bincount(owner, minlength=len(column)), pa.int64())],
                names=["doc_id", "mark", "n_words", "prints"],
            )


def _windows(batches: Iterator[pa.RecordBatch], lengths: list[int], k: int) -> Iterator[pa.RecordBatch]:
    """mark, n, key, start of the windows over the fingerprints that a text shares, of mark, text, prints."""
    for batch in batches:
        for part, column in pieces(batch):
            words = Words(column, NOT_ALNUM, lower=True)
            h, of = words.hashes(), words.text_of()
            shared = part.column(2)
            sizes = np.array([len(x) for x in shared])
            # (text, fingerprint) pairs as one sorted key: equal fingerprints of other texts don't count
            mine = np.sort(np.concatenate([np.empty(0, np.uint64), shared.flatten().to_numpy().view(np.uint64)]) ^ _salted(np.repeat(np.arange(len(column)), sizes)))
            rows = []
            for n, at, value in fingerprints(h, of, lengths, k):
                key = value ^ _salted(of[at])
                near = np.minimum(np.searchsorted(mine, key), max(len(mine) - 1, 0))
                at = at[mine[near] == key] if len(mine) else at[:0]
                start = np.unique((at[:, None] - np.arange(n - min(n, k) + 1)).ravel())
                start = start[(start >= 0) & (start <= len(h) - n)]
                start = start[of[start] == of[start + n - 1]] if len(start) else start
                rows.append((np.full(len(start), n), start, gram_hashes_at(h, start, n)))
            n, start, key = (np.concatenate(x) for x in zip(*rows, strict=True))
            text = of[start] if len(start) else start
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), pa.array(n, pa.int32()), pa.array(signed(key), pa.int64()), pa.array(start - words.first[text], pa.int64())],
                names=["mark", "n", "key", "start"],
            )


def _salted(text: np.ndarray) -> np.ndarray:
    return (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's covered runs of words from the windows found in it."""
    for batch in batches:
        first, end, sizes = [], [], []
        for spans in batch.column(1):
            start, n = (spans.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            order = np.argsort(start, kind="stable")
            start, stop = start[order], np.maximum.accumulate((start + n)[order])
            new = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
            first.append(start[new])
            end.append(stop[np.append(new[1:] - 1, len(stop) - 1)])
            sizes.append(len(new))
        if sizes:
            sizes = np.array(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.concatenate(first), sizes, pa.int64()), lists(np.concatenate(end), sizes, pa.int64())], names=["mark", "first", "end"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, mark (MD5 of the text), n_words, first, end (arrays: covered runs of words), items (strings: item_ids that occur,
    ascending)."""
    named = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = stored(named.mapInArrow(lambda batches: _items(batches, window, k), "item string, n int, keys array<long>, prints array<long>").filter("n > 0"), "decontaminate-items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # window numbers at most
    windows = stored(items.select("item", "n", F.explode("keys").alias("key")).distinct(), "decontaminate-windows")
    known = stored(items.select(F.explode("prints").alias("print")).distinct(), "decontaminate-prints")
    forget(items)
    bits = bitmap(known)

    rows = text_rows(docs).withColumn("mark", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    texts = stored(rows.mapInArrow(lambda batches: _prints(batches, lengths, k, bits), "doc_id long, mark string, n_words long, prints array<long>"), "decontaminate-texts")
    hits = texts.select("mark", F.explode("prints").alias("print")).join(sized(known), "print")
    hits = stored(hits.groupBy("mark").agg(F.collect_set("print").alias("prints")), "decontaminate-hits")
    n = hits.count()
    near = rows.join(sized(hits, 20 * n), "mark").select("mark", "text", "prints").mapInArrow(lambda batches: _windows(batches, lengths, k), "mark string, n int, key long, start long")
    near = stored(near, "decontaminate-near")
    found = near.join(sized(windows), ["n", "key"])
    found = found.groupBy("mark").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set(F.struct("item")).alias("items"))
    found = stored(found, "decontaminate-found")
    for done in (known, hits, near, windows):
        forget(done)
    runs = found.select("mark", "spans").mapInArrow(_runs, "mark string, first array<long>, end array<long>")
    found = stored(runs.join(found.select("mark", "items"), "mark"), "decontaminate-runs")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    names = F.array_sort(F.coalesce(F.col("items.item"), F.array().cast("array<string>"))).alias("items")
    return texts.join(sized(found, 20 * n), "mark", "left").select("doc_id", "mark", "n_words", none("first", "array<long>"), none("end", "array<long>"), names)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from ``contamination``."""
    covered = F.aggregate(F.zip_with("first", "end", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))
