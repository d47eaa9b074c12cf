"""Bit boards as LONG columns. Every function takes and gives columns, stays inside
whole-stage code generation, and is null where its input is null.

Spark's LONG is signed and its shift counts are taken modulo 64, so boards have at most
63 cells and right shifts are unsigned ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def popcount(m: str | Column) -> Column:
    return F.bit_count(col(m))


def lowest_bit(m: str | Column) -> Column:
    """The lowest set bit as a mask; 0 of 0."""
    return col(m).bitwiseAND(-col(m))


def lowest_cell(m: str | Column) -> Column:
    """Index of the lowest set bit; null of 0."""
    low = lowest_bit(m)
    return F.when(col(m) != 0, F.bit_count(low - 1))


def clear_lowest(m: str | Column) -> Column:
    return col(m).bitwiseAND(col(m) - 1)


def bit(cell: int | Column) -> Column:
    """Mask of one cell, 0 <= cell < 63."""
    return F.lit(1 << cell).cast("long") if isinstance(cell, int) else F.call_function("shiftleft", F.lit(1).cast("long"), cell.cast("int"))


def has(m: str | Column, cell: int | Column) -> Column:
    return col(m).bitwiseAND(bit(cell)) != 0


def put(m: str | Column, cell: int | Column) -> Column:
    return col(m).bitwiseOR(bit(cell))


def drop(m: str | Column, cell: int | Column) -> Column:
    return col(m).bitwiseAND(F.bitwise_not(bit(cell)))


def shift(m: str | Column, by: int) -> Column:
    """Towards higher cells for by > 0, lower for by < 0."""
    return F.shiftleft(col(m), by) if by >= 0 else F.shiftrightunsigned(col(m), -by)


def cells(m: str | Column, n: int) -> Column:
    """Ascending array of the set cells below n."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(col(m), i) == 1)


def from_cells(a: str | Column) -> Column:
    """Mask of an array of cells; repeated cells count once."""
    return F.aggregate(col(a), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def permute(m: str | Column, perm: list[int]) -> Column:
    """Cell i goes to cell perm[i]; cells that move by the same distance move together,
    so a board symmetry is a few masked shifts."""
    moves: dict[int, int] = {}
    for i, j in enumerate(perm):
        moves[j - i] = moves.get(j - i, 0) | (1 << i)
    return reduce(lambda a, b: a.bitwiseOR(b), (shift(col(m).bitwiseAND(F.lit(k).cast("long")), d) for d, k in sorted(moves.items())))


def gather(m: str | Column, mask: int) -> Column:
    """The cells of mask, packed to the low end in order."""
    at = [i for i in range(63) if mask >> i & 1]
    return reduce(lambda a, b: a.bitwiseOR(b), (shift(col(m).bitwiseAND(F.lit(1 << c).cast("long")), k - c) for k, c in enumerate(at)), F.lit(0).cast("long"))


def scatter(m: str | Column, mask: int) -> Column:
    """The inverse of gather: low cells spread to the cells of mask."""
    at = [i for i in range(63) if mask >> i & 1]
    return reduce(lambda a, b: a.bitwiseOR(b), (shift(col(m).bitwiseAND(F.lit(1 << k).cast("long")), c - k) for k, c in enumerate(at)), F.lit(0).cast("long"))


def pack(digits: str | Column, base: int) -> Column:
    """One LONG of an array of digits, the first the least significant."""
    return F.aggregate(F.reverse(col(digits)), F.lit(0).cast("long"), lambda a, x: a * base + x.cast("long"))


def unpack(key: str | Column, base: int, n: int) -> Column:
    """n digits, the least significant first."""
    powers = F.array(*[F.lit(base**i).cast("long") for i in range(n)])
    return F.transform(powers, lambda p: F.pmod(F.call_function("div", col(key), p), F.lit(base)).cast("int"))


def lines_of_four(m: str | Column, strides: list[int]) -> Column:
    """Whether four cells in a row are set along any stride; the caller's layout keeps
    rows apart by an empty cell."""
    m = col(m)
    hits = []
    for s in strides:
        pair = m.bitwiseAND(shift(m, -s))
        hits.append(pair.bitwiseAND(shift(pair, -2 * s)) != 0)
    return reduce(lambda a, b: a | b, hits)


def flood(seed: str | Column, free: str | Column, w: int, h: int) -> Column:
    """Cells of free that seed reaches in steps up, down, left and right on a w x h board
    (cell = y * w + x). w * h rounds reach everything; no Python runs on the rows."""
    left = sum(1 << (y * w) for y in range(h))
    right = left << (w - 1)
    out = col(seed).bitwiseAND(col(free))
    step = lambda m: m.bitwiseOR(shift(m, w)).bitwiseOR(shift(m, -w)).bitwiseOR(shift(m.bitwiseAND(F.lit(~right & ((1 << (w * h)) - 1)).cast("long")), 1)).bitwiseOR(shift(m.bitwiseAND(F.lit(~left & ((1 << (w * h)) - 1)).cast("long")), -1)).bitwiseAND(col(free))
    rounds = F.sequence(F.lit(1), F.lit(w * h))
    return F.aggregate(rounds, out, lambda m, _: step(m))


def swap_sides(value: str | Column) -> Column:
    """A value from the other side's view."""
    return -col(value)


def first_player_view(value: str | Column, ply: str | Column) -> Column:
    return F.when(F.pmod(col(ply), F.lit(2)) == 0, col(value)).otherwise(-col(value))


def cell_name(cell: str | Column, w: int) -> Column:
    """A1 for cell 0, letters along a row."""
    c = col(cell)
    return F.concat(F.char(65 + F.pmod(c, F.lit(w))), (F.floor(c / w) + 1).cast("string"))


def cell_of_name(name: str | Column, w: int) -> Column:
    n = col(name)
    return (F.ascii(F.upper(n)) - 65 + w * (F.substring(n, 2, 9).cast("int") - 1)).cast("int")


def count_char(text: str | Column, ch: str) -> Column:
    return F.char_length(col(text)) - F.char_length(F.replace(col(text), F.lit(ch), F.lit("")))


def part_of(key: str | Column, parts: int) -> Column:
    """A partition number that depends on the key alone."""
    return F.pmod(F.xxhash64(col(key)), F.lit(parts)).cast("int")


def crossing(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross inside both."""
    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def item_hash(*columns) -> Column:
    """60 bits of an item's hash: the same wherever it is computed, in any engine with md5."""
    text = F.concat_ws("|", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def set_hash(item: str | Column = "item") -> Column:
    """The hash of a group of items in any order: an aggregate that combines partially. Items
    that are there twice cancel out, so a number that tells them apart belongs into each."""
    return F.bit_xor(item)


def updated_hash(old: str, removed: str, added: str) -> Column:
    """The hash after items were taken out and put in, from the hashes of those alone; null for
    none."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return none(old).bitwiseXOR(none(removed)).bitwiseXOR(none(added))
