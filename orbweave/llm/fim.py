"""Fill-in-the-middle rearrangement of whole texts by ropes.

A rope is a binary tree over slices of a text; leaves and inner nodes cache how many units and how many code points they hold. A text
is cut at two unit ranks by splitting its rope, the three subtrees and the sentinels are concatenated in the form's order, and
only the result is written out. The inverse builds a rope of the output, splits it at the sentinels and concatenates the subtrees
in the text's order.

Units are code points, or what a pattern cuts a text into: a unit ends where a match ends, what lies between matches belongs to the next
unit, and what follows the last match to the last unit. Forms: plain (the text itself), psm (prefix, suffix, middle) and spm (suffix, prefix,
middle). Texts that hold a sentinel stay plain, so that each output can be inverted.

A null text counts as empty, an empty one stays plain with 0 units; a null id draws as an empty one does. Rows are independent of each
other: rows of one id and text give the same output, an empty table gives no rows. A very long text is one rope in one task. Other columns are
ignored by ``fill_in_middle`` and kept by ``restored``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orbweave.llm.common import pieces, text_rows

#: Fixed values of the contract: what stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf (a single longer unit is a leaf of its own).
LEAF = 4096


@dataclass(frozen=True, slots=True)
class Leaf:
    """A slice of a text; ``ends`` are the ends of its units in it, None where each code point is a unit."""

    text: str
    ends: tuple[int, ...] | None
    units: int
    chars: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    chars: int


Rope = Leaf | Node
EMPTY = Leaf("", None, 0, 0)


def leaf(text: str, ends: tuple[int, ...] | None = None) -> Leaf:
    return Leaf(text, ends, len(text) if ends is None else len(ends), len(text))


def concat(left: Rope, right: Rope) -> Rope:
    if not left.chars:
        return right
    return Node(left, right, left.units + right.units, left.chars + right.chars) if right.chars else left


def unit_ends(text: str, unit: str) -> list[int]:
    """Where the units of a text end: at the ends of matches, the last one at the text's end."""
    ends = [m.end() for m in re.finditer(unit, text) if m.end()]
    ends = [b for a, b in zip([0, *ends], ends, strict=False) if b > a]
    return [*ends[:-1], len(text)] if text else []


def rope_of(text: str, unit: str | None = None, size: int = LEAF) -> Rope:
    """A balanced rope of a text."""
    if unit is None:
        nodes: list[Rope] = [leaf(text[i : i + size]) for i in range(0, len(text), size)]
    else:
        nodes, at, mine = [], 0, []
        ends = unit_ends(text, unit)
        for e in ends:
            mine.append(e - at)
            if e - at >= size or e == ends[-1]:
                nodes.append(leaf(text[at:e], tuple(mine)))
                at, mine = e, []
    while len(nodes) > 1:
        nodes = [concat(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0] if nodes else EMPTY


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """What lies before and after a number of units (or ``chars``); subtrees off the way down are shared. A unit that a cut by code
    points breaks counts on both sides."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if isinstance(rope, Node):
        before = getattr(rope.left, by)
        if rank <= before:
            a, b = split(rope.left, rank, by)
            return a, concat(b, rope.right)
        a, b = split(rope.right, rank - before, by)
        return concat(rope.left, a), b
    at = rope.ends[rank - 1] if by == "units" and rope.ends is not None else rank
    if rope.ends is None:
        return leaf(rope.text[:at]), leaf(rope.text[at:])
    whole = [e for e in rope.ends if e <= at]
    first = tuple(whole if whole and whole[-1] == at else [*whole, at])
    return leaf(rope.text[:at], first), leaf(rope.text[at:], tuple(e - at for e in rope.ends if e > at))


def text_of(rope: Rope) -> str:
    """The text of a rope, by its leaves from left to right."""
    out, open_ = [], [rope]
    while open_:
        now = open_.pop()
        if isinstance(now, Leaf):
            out.append(now.text)
        else:
            open_ += (now.right, now.left)
    return "".join(out)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers that an id stands for."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i : i + 8], 16) for i in range(0, 32, 8)]


def order_of(form: str, prefix, suffix, middle, sentinels: tuple[str, str, str]) -> list:
    """Sentinels and parts of a form, in its order."""
    p, s, m = sentinels
    return [p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle]


def arranged(text: str, doc_id: int | None, seed: int, plain_percent: int, spm_percent: int, unit: str | None, sentinels: tuple[str, str, str]) -> tuple:
    """n, form, code points of prefix and middle (None if plain), output of one text."""
    rope = rope_of(text, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = rope.units
    if not text or any(s in text for s in sentinels) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm_percent else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(rope, a)
    middle, suffix = split(rest, b - a)
    made = EMPTY
    for part in order_of(form, prefix, suffix, middle, sentinels):
        made = concat(made, leaf(part) if isinstance(part, str) else part)
    return n, form, prefix.chars, middle.chars, text_of(made)


def inverted(output: str | None, form: str | None, sentinels: tuple[str, str, str] = SENTINELS) -> str | None:
    """The text an output was made of; None for a null or an output that isn't of its form."""
    if output is None or form not in ("plain", "psm", "spm"):
        return None
    if form == "plain":
        return output
    order = order_of(form, "prefix", "suffix", "middle", sentinels)
    rest, at, parts = rope_of(output), 0, {}
    found = []
    for sentinel in order[::2]:
        at = output.find(sentinel, at)
        if at < 0:
            return None
        found.append(at)
    if found[0]:
        return None
    for i, (sentinel, name) in enumerate(zip(order[::2], order[1::2], strict=True)):
        begin = found[i] + len(sentinel)
        _, rest = split(rest, len(sentinel), "chars")
        parts[name], rest = split(rest, (found[i + 1] if i < 2 else len(output)) - begin, "chars")
    return text_of(concat(concat(parts["prefix"], parts["middle"]), parts["suffix"]))


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Three different strings no end of which begins one of them: they can't arise across the border of a part."""
    a = tuple(sentinels)
    if len(a) != 3 or not all(a) or any(x in y for x, y in permutations(a, 2)):
        raise ValueError("three sentinels, none empty or within another")
    if any(x.endswith(y[:k]) for x in a for y in a for k in range(1, min(len(x), len(y)) + (x != y)) if k < len(y)):
        raise ValueError("a sentinel's end may not begin a sentinel")
    return a


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str | None = None, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output for each row of docs."""
    sentinels = checked(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in pieces(batch):
                ids = part.column(0)
                made = [arranged(text, i, seed, plain_percent, spm_percent, unit, sentinels) for i, text in zip(ids.to_pylist(), column.to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows (with output and form) and ``restored``: the exact text, from these two columns alone."""
    sentinels, rows = checked(sentinels), rows.drop("restored")
    place = [rows.columns.index(c) for c in ("output", "form")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in pieces(batch, "output"):
                texts = [inverted(o, f, sentinels) for o, f in zip(*(part.column(i).to_pylist() for i in place), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "restored"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())]))
