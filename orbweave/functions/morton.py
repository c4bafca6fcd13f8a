"""Morton keys as column expressions: 48 interleaved bits (x, y, z from the highest) above 15 bits of level.

Anchors are in units of the deepest level (16), so a box and its first descendants share their upper bits. All
expressions stay inside whole-stage code generation. Keys fit a non-negative BIGINT.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave.schemas import MAX_DEPTH

LEVEL_BITS, LEVEL_MASK = 15, 0x7FFF
SIDE = 1 << MAX_DEPTH
ROOT = 0
#: Masks that keep every third bit while a number is spread or packed.
SPREAD = ((16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
DIRECTIONS = [d for d in product((-1, 0, 1), repeat=3) if any(d)]


def _and(a: Column, b: int | Column) -> Column:
    return a.bitwiseAND(F.lit(b).cast("long") if isinstance(b, int) else b)


def _spread(a: Column) -> Column:
    for shift, mask in SPREAD:
        a = _and(a.bitwiseOR(F.shiftleft(a, shift)), mask)
    return a


def _packed(a: Column) -> Column:
    a = _and(a, SPREAD[-1][1])
    masks = [SPREAD[2][1], SPREAD[1][1], SPREAD[0][1], 0xFFFF]
    for shift, mask in zip((2, 4, 8, 16), masks, strict=True):
        a = _and(a.bitwiseOR(F.shiftright(a, shift)), mask)
    return a


def encode(ax: Column, ay: Column, az: Column, level: Column | int) -> Column:
    """Key of an anchor at a level.

    The axes go through one lambda: spreading uses its argument 16 times, which must not be a whole expression each time.
    """
    level = F.lit(level) if isinstance(level, int) else level
    axes = F.array(*[a.cast("long") for a in (ax, ay, az)])
    bits = F.aggregate(axes, F.lit(0).cast("long"), lambda acc, a: F.shiftleft(acc, 1).bitwiseOR(_spread(a)))
    return F.shiftleft(bits, LEVEL_BITS).bitwiseOR(level.cast("long"))


def anchor(key: Column) -> tuple[Column, Column, Column]:
    bits = F.shiftright(key, LEVEL_BITS)
    return _packed(F.shiftright(bits, 2)), _packed(F.shiftright(bits, 1)), _packed(bits)


def level(key: Column) -> Column:
    return _and(key, LEVEL_MASK).cast("int")


def _step(lev: Column | int) -> Column:
    """Edge of a box in deepest units."""
    return _shifted(1, F.lit(MAX_DEPTH) - lev)


def _shifted(a: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(a).cast("long") if isinstance(a, int) else a, by.cast("int"))


def point_anchor(axis: Column, origin: float, side: float, lev: int) -> Column:
    """One axis of a point's anchor; a point outside the domain is an error."""
    inside = (axis >= origin) & (axis <= origin + side)
    cell = F.least(F.floor((axis - F.lit(origin)) / F.lit(side / (1 << lev))), F.lit((1 << lev) - 1)) * (1 << (MAX_DEPTH - lev))
    return F.when(inside, cell).otherwise(F.raise_error(F.lit("Point not in Domain")).cast("long"))


def from_point(x: Column, y: Column, z: Column, domain, lev: int) -> Column:
    """Key of the box at a level that holds a point."""
    o = domain.origin
    return encode(*[point_anchor(c, o[i], domain.side, lev) for i, c in enumerate((x, y, z))], lev)


def at_level(key: Column, lev: Column | int) -> Column:
    """The ancestor at a level (the key itself at its own)."""
    lev = F.lit(lev) if isinstance(lev, int) else lev
    low = (F.lit(LEVEL_BITS) + 3 * (F.lit(MAX_DEPTH) - lev)).cast("int")
    cleared = F.when(lev <= 0, F.lit(0).cast("long")).otherwise(_shifted(F.call_function("shiftright", key, low), low))
    return cleared.bitwiseOR(lev.cast("long"))


def parent(key: Column) -> Column:
    """Null for the root."""
    return F.when(level(key) > 0, at_level(key, level(key) - 1))


def first_child(key: Column, by: int = 1) -> Column:
    return key + by


def finest_first_child(key: Column) -> Column:
    return key - level(key).cast("long") + MAX_DEPTH


def last_child(key: Column, lev: Column | int) -> Column:
    """The largest descendant at a level."""
    lev = F.lit(lev) if isinstance(lev, int) else lev
    span = _shifted(1, 3 * (F.lit(MAX_DEPTH) - level(key))) - _shifted(1, 3 * (F.lit(MAX_DEPTH) - lev))
    return (key - level(key).cast("long")) + F.shiftleft(span, LEVEL_BITS) + lev.cast("long")


def finest_last_child(key: Column) -> Column:
    return last_child(key, MAX_DEPTH)


def descendants(key: Column, by: int = 1) -> Column:
    """Array of the 8**by descendants ``by`` levels down, ascending; an error below the deepest level."""
    lev = level(key) + by
    unit = _shifted(1, LEVEL_BITS + 3 * (F.lit(MAX_DEPTH) - lev))
    made = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(8**by - 1).cast("long")), lambda i: key + by + i * unit)
    return F.when(lev <= MAX_DEPTH, made).otherwise(F.raise_error(F.lit("no boxes below the deepest level")).cast("array<bigint>"))


def children(key: Column) -> Column:
    return descendants(key, 1)


def siblings(key: Column) -> Column:
    return F.when(level(key) > 0, descendants(at_level(key, level(key) - 1), 1)).otherwise(F.array(key))


def ancestors(key: Column, down_to: Column | int = 0) -> Column:
    """Array of the key and its ancestors up to a level, finest first."""
    low = F.lit(down_to) if isinstance(down_to, int) else down_to
    return F.transform(F.sequence(level(key), low.cast("int"), F.lit(-1)), lambda lev: at_level(key, lev))


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether a is b or above it."""
    return (level(a) <= level(b)) & (at_level(b, level(a)) == a)


def is_descendant(a: Column, b: Column) -> Column:
    return is_ancestor(b, a)


def finest_ancestor(a: Column, b: Column) -> Column:
    """The deepest box above (or equal to) both."""
    differ = F.shiftright(a, LEVEL_BITS).bitwiseXOR(F.shiftright(b, LEVEL_BITS))
    bits = F.when(differ == 0, 0).otherwise(F.length(F.bin(differ)))
    same = F.lit(MAX_DEPTH) - F.ceil(bits / 3).cast("int")
    return at_level(a, F.least(same, level(a), level(b)))


def diameter(key: Column, side: float) -> Column:
    return F.lit(side) / F.pow(F.lit(2.0), level(key))


def coordinates(key: Column, domain) -> tuple[Column, Column, Column]:
    """Lower corner of the box."""
    return tuple(F.lit(domain.origin[i]) + a * F.lit(domain.side / SIDE) for i, a in enumerate(anchor(key)))


def centre(key: Column, domain) -> tuple[Column, Column, Column]:
    return tuple(c + diameter(key, domain.side) / 2 for c in coordinates(key, domain))


def box_coordinates(key: Column, domain) -> Column:
    """24 numbers: the 8 corners, x fastest."""
    low, d = coordinates(key, domain), diameter(key, domain.side)
    return F.array(*[low[axis] + (d if bit else F.lit(0.0)) for k, j, i in product((0, 1), repeat=3) for axis, bit in enumerate((i, j, k))])


#: Bits of one axis among the interleaved 48; small numbers with their bits spread the same way.
_ALL = (1 << 48) - 1
_AXIS = [sum(1 << (3 * i + 2 - axis) for i in range(16)) for axis in range(3)]
_SPREAD_SMALL = (0, 1, 8, 9)


def _moved(key: Column, axis: int, d: int) -> Column:
    """One axis' bits of the box ``d`` boxes away on it; null outside the domain.

    Adds to an axis in place: the other axes' bits are filled with ones (or zeros) so that carries run through them; an
    overflow shows as a number that moved the wrong way.
    """
    bits = F.shiftright(key, LEVEL_BITS)
    mine = _and(bits, _AXIS[axis])
    if not d:
        return mine
    unit = _shifted(_SPREAD_SMALL[abs(d)] << (2 - axis), 3 * (F.lit(MAX_DEPTH) - level(key)))
    if d > 0:
        there = _and(bits.bitwiseOR(F.lit(_ALL ^ _AXIS[axis]).cast("long")) + unit, _AXIS[axis])
        return F.when((there > mine) & (unit <= _ALL), there)
    there = _and(mine - unit, _AXIS[axis])
    return F.when((there < mine) & (unit <= _ALL), there)


def _joined(x: Column, y: Column, z: Column, lev: Column) -> Column:
    """The key of three axes' bits; null if one is."""
    return F.shiftleft(x.bitwiseOR(y).bitwiseOR(z), LEVEL_BITS).bitwiseOR(lev.cast("long"))


def in_direction(key: Column, dx: int, dy: int, dz: int) -> Column:
    """The box of the same level up to 3 boxes away on each axis; null outside the domain."""
    return _joined(*[_moved(key, axis, d) for axis, d in enumerate((dx, dy, dz))], level(key))


def neighbours(key: Column, missing: bool = False) -> Column:
    """The up to 26 boxes around; with ``missing`` 26 entries, null outside the domain."""
    lev, moved = level(key), [{d: _moved(key, axis, d) for d in (-1, 0, 1)} for axis in range(3)]
    made = F.array(*[_joined(*[m[x] for m, x in zip(moved, d, strict=True)], lev) for d in DIRECTIONS])
    return made if missing else F.filter(made, lambda k: k.isNotNull())


def blocks_around(key: Column, reach: int, block: int) -> Column:
    """Array of the boxes of level ``block`` that hold a box up to ``reach`` boxes away on each axis, the own one included.

    An axis has at most three of them, as a block's edge is ``reach`` boxes or more (or the whole domain).
    """
    above = ~((1 << 3 * (MAX_DEPTH - block)) - 1)
    x, y, z = (F.array_distinct(F.array_compact(F.array(*[_and(_moved(key, axis, d), _ALL & above) for d in (-reach, 0, reach)]))) for axis in range(3))
    lev = F.lit(block)
    return F.flatten(F.transform(x, lambda a: F.flatten(F.transform(y, lambda b: F.transform(z, lambda c: _joined(a, b, c, lev))))))


def is_adjacent(a: Column, b: Column) -> Column:
    """Whether two boxes touch and neither holds the other."""
    return touches(a, b) & ~is_ancestor(a, b) & ~is_ancestor(b, a)


def touches(a: Column, b: Column) -> Column:
    """Whether two closed boxes meet (their own size may differ)."""
    ok = F.lit(True)
    sa, sb = _step(level(a)), _step(level(b))
    for p, q in zip(anchor(a), anchor(b), strict=True):
        ok = ok & (F.abs(2 * p + sa - 2 * q - sb) <= sa + sb)
    return ok


def transfer_components(source: Column, target: Column) -> tuple[Column, Column, Column]:
    """Integer offset source - target in boxes; an error above level 2 or for boxes of different levels."""
    step = _step(level(source))
    sound = (level(source) >= 2) & (level(source) == level(target))
    return tuple(F.when(sound, ((s - t) / step).cast("int")).otherwise(F.raise_error(F.lit("transfer vectors start at level 2")).cast("int")) for s, t in zip(anchor(source), anchor(target), strict=True))


def transfer_hash(dx: Column, dy: Column, dz: Column) -> Column:
    """Components zig-zag coded (negative n: 2|n| + 1, else 2n), 16 bits each."""
    code = lambda n: F.when(n < 0, 2 * F.abs(n) + 1).otherwise(2 * n).cast("long")
    return F.shiftleft(code(dx), 32).bitwiseOR(F.shiftleft(code(dy), 16)).bitwiseOR(code(dz))
