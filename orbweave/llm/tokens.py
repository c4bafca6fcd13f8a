"""Token ids of a corpus in Simple-8b files, in ascending doc_id order.

``write_tokens`` sorts documents by id into range partitions of about ``SHARD_BYTES`` bytes of text (rows of one id, or of
none, by hash of text and place in the input, so that a hot id spreads), encodes each with the tokenizer, appends the end id and
writes segments of about ``SEGMENT_IDS`` ids; a document never spans two. A segment is one binary record
(``HEADER``, block offsets, words; see ``simple8b``) in a Parquet container, so that Spark's committer makes retried
tasks harmless and any Hadoop store can hold the files. ``read_tokens`` reads the files back.

Equal texts give equal ids, so a worker keeps the ids of the words it has met (a bounded table). A byte-level BPE
splits before every space that a non-space follows, around a line feed before one, and before punctuation that follows a letter or
digit, hence a word with its space, and the punctuation at its end, encode alone as they do in the text; texts
with other uses of the space, or that hold a special token's string, are encoded whole.

Nulls: a null text is empty (the end id alone), as an empty one is; null ids come first. Rows of one id are ordered by the hash of
their texts. Repeated rows are rows. A very long text is one record of one segment. An empty table gives no segments. Other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import simple8b
from orbweave.llm.common import SPACE, U, Words, pieces, shared_dir, sized, span_hashes, stored, text_rows

SEGMENT_IDS, SHARD_BYTES = 1 << 18, 128 << 20
#: Magic, ids, blocks, words: little-endian 64-bit each.
HEADER = np.dtype([("magic", "<u8"), ("ids", "<u8"), ("blocks", "<u8"), ("words", "<u8")])
MAGIC = 0x31423853_4F525731
#: Words that a worker keeps the ids of, and bytes of text that it encodes at once: both bound its memory.
KNOWN_WORDS, TEXT_BYTES = 500_000, 1 << 20
SEGMENT = "shard int, segment int, doc_ids array<long>, sizes array<int>, payload binary"

ONLY_SPACE = np.zeros(256, bool)
ONLY_SPACE[0x20] = True
BLANK, MAYBE_BLANK = SPACE.copy(), np.zeros(256, bool)
BLANK[0x1C:0x20] = True
MAYBE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of white space beyond ASCII
ASCII_ALNUM, ASCII_LETTER, PUNCTUATION, LATIN = (np.zeros(256, bool) for _ in range(4))
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
ASCII_ALNUM[[*range(0x30, 0x3A), *np.flatnonzero(ASCII_LETTER)]] = True
PUNCTUATION[0x21:0x7F] = ~ASCII_ALNUM[0x21:0x7F]
LATIN[0x80:0xC0] = True  # second bytes of Latin-1 letters after 0xC3
LATIN[[0x97, 0xB7]] = False
#: Words that go to the model in one call, whose memory grows with them.
CODED_WORDS = 2000
#: Bytes of punctuation at a word's end that are looked at (with more, the word stays whole), ids of a word that is kept, and of all.
LONGEST_TAIL, LONGEST_KEPT, POOL_IDS = 8, 64, 8_000_000


def pack(ids: np.ndarray) -> bytes:
    words, blocks = simple8b.encode(ids)
    head = np.array([(MAGIC, len(ids), len(blocks) - 1, len(words))], HEADER)
    return head.tobytes() + blocks.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    head = np.frombuffer(payload, HEADER, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a segment")
    blocks = np.frombuffer(payload, "<u8", int(head["blocks"]) + 1, HEADER.itemsize)
    words = np.frombuffer(payload, "<u8", int(head["words"]), HEADER.itemsize + blocks.nbytes)
    ids = simple8b.decode(words, blocks)
    if len(ids) != head["ids"]:
        raise ValueError("segment is cut short")
    return ids


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable in Latin-1, else the next character from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, following = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(following))
        following += b not in own
    return out


def line_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Line feeds inside texts with no space before and no white space after them: each is a piece of its own for the tokenizer."""
    found = np.flatnonzero(data == 0x0A)
    inner = np.ones(len(data) + 1, bool)
    inner[at[:-1]] = False
    inner[at[1:] - (at[1:] > at[:-1])] = False
    found = found[inner[found]]
    after = data[found + 1]
    return found[(data[found - 1] != 0x20) & ~BLANK[after] & ~MAYBE_BLANK[after]]


def stem_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where each word's last ASCII punctuation begins, if a letter or digit stands before it; else its end."""
    out, now = end.copy(), np.flatnonzero(PUNCTUATION[data[end - 1]])
    at = end[now] - 1
    for _ in range(LONGEST_TAIL):
        inside = at > start[now]
        now, at = now[inside], at[inside]
        before = data[at - 1]
        stem = ASCII_ALNUM[before] | (LATIN[before] & (data[np.maximum(at - 2, 0)] == 0xC3))
        out[now[stem]] = at[stem]
        more = PUNCTUATION[before]
        now, at = now[more], at[more] - 1
    return out


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out), dtype=out.dtype)
    return out


class Encoder:
    """Ids of texts by way of known words, each with the space before it (a line's first word without).

    Words end at spaces and at line feeds between words. Punctuation after a letter or digit at a word's end is, with the line feed that
    follows, a piece of its own for the tokenizer and a word here. Words are found and looked up by 64-bit hashes of their bytes, a piece of
    texts at a time, in a table of ``KNOWN_WORDS`` places: a word has two, and takes the one whose word was met longer ago. Words that
    aren't found go to the model: words of letters are one piece for it and skip its splitting pattern, others are joined into one
    text, where the tokens that start with a space show where each begins.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores; threads of its own would cost memory beside them
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.model = Tokenizer.from_file(path)
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.whole = Tokenizer(self.model.model)  # what stands between spaces is one piece
        self.whole.pre_tokenizer = CharDelimiterSplit(" ")
        size = self.model.get_vocab_size()
        self.leads = np.zeros(size, bool)
        alphabet = byte_alphabet()
        self.codes = np.array([*map(ord, alphabet)], np.uint32)
        for token, i in self.model.get_vocab().items():
            self.leads[i] = token.startswith(alphabet[0x20])
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        alone = lambda text: self.model.encode(text, add_special_tokens=False).ids
        self.bare = self.model.normalizer is None and alone("a b.\nc%%\n\u00e9,") == [x for w in ("a", " b", ".", "\n", "c", "%%", "\n", "\u00e9", ",") for x in alone(w)]
        for word in ("a", " Thxb", "\u00e9tr\u00df", " n\u00e6\u00e9v"):  # a vocabulary of bytes, by way of ``whole`` as well
            self.bare &= self.whole.encode("".join(alphabet[b] for b in word.encode()), add_special_tokens=False).ids == alone(word)
            self.bare &= self.leads[alone(word)].tolist() == [word[0] == " ", *[False] * (len(alone(word)) - 1)]
        self.reset()

    def reset(self) -> None:
        n = KNOWN_WORDS
        self.keys, self.used = np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.keys[0] = U(2**64 - 1)  # an empty place holds a key that belongs elsewhere
        self.begin, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.pool, self.now = np.empty(0, self.kind), 0

    def _places(self, half: np.ndarray) -> np.ndarray:
        """Places by either half of the keys, 32 bits."""
        return (half * U(len(self.keys)) >> U(32)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and which keys have none."""
        place = self._places(keys >> U(32))
        other = np.flatnonzero(self.keys[place] != keys)
        second = self._places(keys[other] & U(2**32 - 1))
        there = self.keys[second] == keys[other]
        place[other[there]] = second[there]
        missing = other[~there]
        known = np.ones(len(keys), bool)
        known[missing] = False
        self.now += 1
        self.used[place[known]] = self.now
        return place, missing

    def _keep(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """New words into the table; ``begin`` is within the pool."""
        some = np.flatnonzero(size <= LONGEST_KEPT)
        one, two = self._places(keys[some] >> U(32)), self._places(keys[some] & U(2**32 - 1))
        place, mine = np.unique(np.where(self.used[one] <= self.used[two], one, two), return_index=True)
        some = some[mine]
        self.keys[place], self.begin[place], self.size[place], self.used[place] = keys[some], begin[some], size[some], self.now
        if len(self.pool) > POOL_IDS:  # ids of forgotten words go
            live = np.flatnonzero(self.size)
            if int(self.size[live].sum()) > POOL_IDS // 2:
                self.reset()
            else:
                self.pool = self.pool[spans(self.begin[live], self.size[live])]
                self.begin[live] = np.cumsum(self.size[live]) - self.size[live]

    def _letters(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the words that ``data`` holds one after the other are ASCII and Latin-1 letters alone."""
        after = np.append(data[1:], np.uint8(0))
        pair = (data == 0xC3) & LATIN[after]
        ok = ASCII_LETTER[data] | pair
        ok[1:] |= pair[:-1]
        return ~np.logical_or.reduceat(~ok, at)

    def _coded(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and how many each has: each begins with the one token that starts with a space, its own or a space alone."""
        room = size + 2 + ~led  # its space, the word and what splits; in between too if the space is alone
        to = np.cumsum(room) - room
        codes = np.full(int(room.sum()), 0x20, np.uint32)
        codes[to] = self.codes[0x20]
        codes[spans(to + 1 + ~led, size)] = self.codes[data[spans(at, size)]]
        ids = np.array(self.whole.encode_batch_fast([codes.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, self.kind)
        first = np.flatnonzero(self.leads[ids])
        counts = np.diff(np.append(first, len(ids)))
        own = np.ones(len(ids), bool)
        own[first[~led]] = False
        return ids[own], counts - ~led

    def _ids_of(self, words: list[str], led: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words one after the other, and how many each has."""
        if led:
            parts = []
            for lo in range(0, len(words), CODED_WORDS):
                some = words[lo : lo + CODED_WORDS]
                ids = np.array(self.model.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
                first = np.flatnonzero(self.leads[ids])
                parts.append((ids, np.diff(np.append(first, len(ids)))))
            ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(counts) == len(words):
                return ids, counts
            words = [" " + w for w in words]  # a word has a token inside that starts with a space
        coded = [x.ids for x in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(coded), self.kind), np.fromiter(map(len, coded), np.int64, len(coded))

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words with or without the space before them, and where each word's begin and how many they are."""
        size = end - start
        at = np.cumsum(size) - size
        flat = data[spans(start, size)]
        letters = self._letters(flat, at)
        groups = [np.flatnonzero(letters), np.flatnonzero(~letters & led), np.flatnonzero(~letters & ~led)]
        parts, raw = [], flat.tobytes()
        for i, mine in enumerate(groups):
            if not len(mine):
                parts.append((np.empty(0, self.kind), np.empty(0, np.int64)))
            elif i == 0:
                some = np.array_split(mine, -(-len(mine) // CODED_WORDS))
                parts += [self._coded(flat, at[x], size[x], led[x]) for x in some]
            else:
                parts.append(self._ids_of([raw[a : a + n].decode() for a, n in zip(at[mine].tolist(), size[mine].tolist(), strict=True)], i == 1))
        ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        begin, many, order = np.empty(len(start), np.int64), np.empty(len(start), np.int64), np.concatenate(groups)
        begin[order], many[order] = np.cumsum(counts) - counts, counts
        return ids, begin, many

    def _unsafe(self, words: Words, column: pa.Array) -> np.ndarray:
        """Texts where a space comes before white space or the end, or that hold a special token's string."""
        data, at = words.data, words.at
        after = np.flatnonzero(data == 0x20) + 1
        last = np.append(data, [0x20, 0x20, 0x20])
        ends = np.zeros(len(data) + 1, bool)
        ends[at[1:]] = True
        blank = BLANK[last[after]] | ends[after]
        more = np.flatnonzero(MAYBE_BLANK[last[after]])
        a, b, c = (last[after[more] + i] for i in range(3))
        found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        found |= (a == 0xE2) & ((b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        blank[more[found]] = True
        out = np.zeros(len(at) - 1, bool)
        out[np.searchsorted(at, after[blank] - 1, "right") - 1] = True
        for x in self.special:
            out |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if not self.bare:
            return self._ids_of(column.to_pylist(), False)
        words = Words(column, ONLY_SPACE, also=line_ends)
        data, end = words.data, words.end
        text = words.text_of()
        led = (words.start > words.at[text]) & (data[words.start - 1] == 0x20)
        stem = stem_ends(data, words.start, end)
        stop = end + ((end < words.at[text + 1]) & (data[np.minimum(end, len(data) - 1)] == 0x0A))
        tail = stop > stem
        n = len(stem) + int(tail.sum())
        own = np.arange(len(stem)) + np.cumsum(tail) - tail
        start, ends, lead = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
        start[own], ends[own], lead[own] = words.start, stem, led
        own_tail = own[tail] + 1
        start[own_tail], ends[own_tail] = stem[tail], stop[tail]
        keys = span_hashes(data, start, ends) ^ np.where(lead, U(0), U(0x9E3779B97F4A7C15))
        place, missing = self._find(keys)
        begin, size = self.begin[place], self.size[place]
        if len(missing):
            new, first, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[first]
            ids, new_begin, new_size = self.learn(data, start[at], ends[at], lead[at])
            new_begin += len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
            begin[missing], size[missing] = new_begin[inverse], new_size[inverse]
        ids = self.pool[spans(begin, size)].astype(np.uint32)
        if len(missing):
            self._keep(new, new_begin, new_size)
        counts = np.diff(np.append(0, np.cumsum(size))[np.append(own, n)[words.first]])
        unsafe = np.flatnonzero(self._unsafe(words, column))
        if len(unsafe):
            edges = np.concatenate([[0], np.cumsum(counts)])
            parts, done = [], 0
            for i in unsafe.tolist():
                mine = np.array(self.model.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
                parts += [ids[edges[done] : edges[i]], mine]
                counts[i], done = len(mine), i + 1
            ids = np.concatenate([*parts, ids[edges[done] :]])
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def segments(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    coder, shard, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
    ids, docs, sizes, count = [], [], [], 0

    def close() -> pa.RecordBatch:
        whole = np.concatenate(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(whole)], pa.binary())],
            names=["shard", "segment", "doc_ids", "sizes", "payload"],
        )

    for batch in batches:
        for part, column in pieces(batch, size=TEXT_BYTES):
            coded, counts = coder.encode(column)
            stops = np.cumsum(counts)
            coded = np.insert(coded, stops, end_id)  # the end id after each text
            counts = counts + 1
            names, lo = part.column(0).to_pylist(), 0
            while lo < len(names):  # as many texts as the segment has room for, one at least
                room = np.cumsum(counts[lo:])
                hi = lo + min(int(np.searchsorted(room, SEGMENT_IDS - count)) + 1, len(names) - lo)
                base = int(counts[:lo].sum())
                ids.append(coded[base : base + int(counts[lo:hi].sum())])
                docs += names[lo:hi]
                sizes += counts[lo:hi].tolist()
                count += len(ids[-1])
                lo = hi
                if count >= SEGMENT_IDS:
                    yield close()
                    ids, docs, sizes, count, number = [], [], [], 0, number + 1
    if docs:
        yield close()


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the files and returns a frame that reads them: shard, segment, doc_ids, sizes, payload."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{__import__('uuid').uuid4().hex}"
    rows = text_rows(docs)
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    placed = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order[:2])
    coded = placed.select("doc_id", "text").mapInArrow(lambda batches: segments(batches, vocabulary, end_id), SEGMENT)
    coded.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(coded.schema).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):  # one segment's lists at a time
            ids = unpack(row["payload"]).astype("<u4")
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    sums = files.select("shard", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    sums = stored(sums, "tokens-sums")
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = sums.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(by_shard), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("base"))
    base = stored(base, "tokens-base")
    rows = files.mapInArrow(_digests, "shard int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(sized(base), ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
