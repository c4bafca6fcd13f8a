"""Simple-8b: varying counts of ids in 64-bit words, vectorised both ways.

A word's top 4 bits are its selector, which says how many values of how many bits fill the other 60; selector 0 is
the escape (the next word is one raw 64-bit value) and selector 15 a run of 240 zeros. Ids are coded in blocks of ``BLOCK``;
a block starts a word of its own, so blocks can be decoded alone by the word offsets kept beside them.
No ids give no words and one offset; equal ids are coded one by one. Ids are unsigned 64-bit numbers, nulls don't occur.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
ESCAPE, ZEROS = 0, 15
#: Fixed values of the format: values in a word and bits of each, by selector; selector 0 stands before a raw word.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240])
WIDTH = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
WORDS = np.array([2] + [1] * 15)
U = np.uint64


def _fits(small: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` members of ``small`` in a row are true."""
    run, have = small, 1
    while have < count:
        step = min(have, count - have)
        if len(run) <= step:
            return np.zeros(0, bool)
        run = run[:-step] & run[step:]
        have += step
        if not run.any():
            return np.zeros(0, bool)
    return run


_BITS = np.repeat(np.arange(17, dtype=np.uint8), [1, *(1 << k for k in range(16))])


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit lengths, 16 bits at a time."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return _BITS[ids.astype(np.intp)]
    out = np.zeros(len(ids), np.uint8)
    for shift in (48, 32, 16, 0):
        part = ids >> U(shift)
        if shift and not part.any():
            continue
        part = (part & U(0xFFFF)).astype(np.intp)
        out = np.where((out == 0) & (part > 0), _BITS[part] + np.uint8(shift), out)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the first word of each block of ``BLOCK`` ids (with the end)."""
    ids = np.ascontiguousarray(ids, U)
    n = len(ids)
    if not n:
        return np.empty(0, U), np.zeros(1, np.int64)
    selector = np.full(n, 14, np.int8)
    bits = _bits(ids)
    selector[bits > 60] = ESCAPE
    room = np.tile(np.arange(BLOCK, 0, -1, np.int16), -(-n // BLOCK))[:n]
    last = (n - 1) // BLOCK * BLOCK
    room[last:] = np.arange(n - last, 0, -1)
    for s in [*range(13, 0, -1), ZEROS]:  # more values a word win
        fit = _fits(bits <= np.uint8(WIDTH[s]), int(COUNT[s]))
        np.copyto(selector[: len(fit)], np.int8(s), where=fit & (room[: len(fit)] >= np.int16(COUNT[s])))
    jump = COUNT[selector]
    at, stop = np.arange(0, n, BLOCK), np.append(np.arange(BLOCK, n, BLOCK), n)
    steps, lane = [], np.arange(len(at))
    while len(at):
        steps.append(at)
        at = at + jump[at]
        more = at < stop[lane]
        at, lane = at[more], lane[more]
    head = np.zeros(n, bool)
    head[np.concatenate(steps)] = True
    at = np.flatnonzero(head)
    chosen = selector[at]
    used = WORDS[chosen]
    place = np.cumsum(used) - used
    out = np.zeros(int(used.sum()), U)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        to, first = place[mine], at[mine]
        out[to] = U(int(s) << 60)
        if s == ESCAPE:
            out[to + 1] = ids[first]
        elif s != ZEROS:
            word = out[to]
            for j in range(int(COUNT[s])):
                word |= ids[first + j] << U(j * int(WIDTH[s]))
            out[to] = word
    borders = np.searchsorted(at, np.append(np.arange(0, n, BLOCK), n))
    return out, np.append(place, len(out))[borders].astype(np.int64)


def heads_of(words: np.ndarray) -> np.ndarray:
    """Which words hold a selector. A raw word may look like an escape itself; but where words that look so stand in a row the first is a
    head, and then every other one."""
    escape = words >> U(60) == ESCAPE
    begins = np.flatnonzero(escape & ~np.r_[False, escape[:-1]])
    if not len(begins):
        return np.ones(len(words), bool)
    at = np.flatnonzero(escape)
    first = begins[np.searchsorted(begins, at, "right") - 1]
    raw = at[(at - first) % 2 == 0] + 1
    out = np.ones(len(words) + 1, bool)
    out[raw] = False
    return out[:-1]


def decode(words: np.ndarray, blocks: np.ndarray, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``stop`` - 1 (all by default), by the blocks' first words: no word of another block is read.

    Each block but the table's last holds ``BLOCK`` ids, so its ids' places are known before any other is decoded. Offsets that don't
    fit the words raise ValueError.
    """
    blocks = np.asarray(blocks, np.int64)
    stop = len(blocks) - 1 if stop is None else stop
    bounds = blocks[first : stop + 1]
    if stop <= first:
        if len(words) and len(blocks) == 1:
            raise ValueError("words without blocks")
        return np.empty(0, U)
    if (np.diff(bounds) <= 0).any() or bounds[0] < 0 or blocks[-1] != len(words) or blocks[0] != 0:
        raise ValueError("block offsets don't fit the words")
    words, bounds = words[bounds[0] : bounds[-1]], bounds - bounds[0]
    head = heads_of(words)
    if not head[bounds[:-1]].all():
        raise ValueError("a block starts with a selector")
    heads = np.flatnonzero(head)
    chosen = (words[heads] >> U(60)).astype(np.int64)
    if chosen[-1] == ESCAPE and heads[-1] + 1 == len(words):
        raise ValueError("an escape without its word")
    counts = COUNT[chosen]
    begins = np.searchsorted(heads, bounds[:-1])
    sizes = np.add.reduceat(counts, begins)
    whole = sizes[:-1] if stop == len(blocks) - 1 else sizes
    if (whole != BLOCK).any() or not 0 < sizes[-1] <= BLOCK:
        raise ValueError("block offsets don't fit the words")
    inside = np.cumsum(counts) - counts
    to = np.repeat(np.arange(len(begins)) * BLOCK - inside[begins], np.diff(np.r_[begins, len(heads)])) + inside
    out = np.zeros((len(begins) - 1) * BLOCK + int(sizes[-1]), U)
    for s in np.unique(chosen):
        mine = chosen == s
        w, place = words[heads[mine]], to[mine]
        if s == ESCAPE:
            out[place] = words[heads[mine] + 1]
        elif s != ZEROS:
            mask = U((1 << int(WIDTH[s])) - 1)
            for j in range(int(COUNT[s])):
                out[place + j] = w >> U(j * int(WIDTH[s])) & mask
    return out
