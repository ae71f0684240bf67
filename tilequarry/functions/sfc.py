"""Space-filling curves over (col, row) tile keys, and the hex code built from them.

The curve is square: both axes have ``bits`` bits, so codes are below 4^bits.
Keys must be non-negative and ``bits`` at most 31.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilequarry.constants import PAD_LENGTH, SFC_HILBERT, SFC_ZORDER


def curve_bits(max_col: Column, max_row: Column) -> Column:
    """Bits per axis that hold every key up to (max_col, max_row); at least 1."""
    return F.length(F.bin(F.greatest(max_col, max_row).cast("bigint")))


# Each step halves the run of adjacent bits: (shift, mask kept).
_SPREAD = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _spread_bits(v: Column) -> Column:
    """Put bit i of a 31-bit value at bit 2i."""
    v = v.cast("bigint")
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _squeeze_bits(v: Column) -> Column:
    """Inverse of _spread_bits; odd bits are ignored."""
    v = v.bitwiseAND(F.lit(_SPREAD[-1][1]))
    masks = [mask for _, mask in reversed(_SPREAD)][1:] + [0x00000000FFFFFFFF]
    for (shift, _), mask in zip(reversed(_SPREAD), masks):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def zorder_encode(col: Column, row: Column) -> Column:
    """Interleave: column on the even bits, row on the odd ones."""
    return _spread_bits(col).bitwiseOR(F.shiftleft(_spread_bits(row), 1))


def zorder_decode(code: Column) -> Column:
    """STRUCT<col, row> of a Z-order code."""
    return F.struct(
        _squeeze_bits(code).alias("col"),
        _squeeze_bits(F.shiftright(code, 1)).alias("row"),
    )


def hilbert_encode(col: Column, row: Column, bits: Column) -> Column:
    """Distance of (col, row) along the Hilbert curve with ``bits`` bits per axis.

    Walks the quadrants from the top bit down, turning the frame as it goes.
    """
    flip = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int")) - 1
    start = F.struct(
        col.cast("bigint").alias("x"), row.cast("bigint").alias("y"),
        F.lit(0).cast("bigint").alias("d"), flip.alias("f"),
    )

    def step(acc: Column, i: Column) -> Column:
        bit = F.lit(1).cast("bigint")
        qx = F.call_function("shiftright", acc["x"], i).bitwiseAND(bit)
        qy = F.call_function("shiftright", acc["y"], i).bitwiseAND(bit)
        quadrant = (qx * 3).bitwiseXOR(qy)
        upper = qy == 1
        mirrored = qx == 1
        return F.struct(
            F.when(upper, acc["x"]).when(mirrored, acc["f"] - acc["y"]).otherwise(acc["y"]).alias("x"),
            F.when(upper, acc["y"]).when(mirrored, acc["f"] - acc["x"]).otherwise(acc["x"]).alias("y"),
            (acc["d"] * 4 + quadrant).alias("d"),
            acc["f"].alias("f"),
        )

    levels = F.sequence(bits.cast("int") - 1, F.lit(0), F.lit(-1))
    return F.aggregate(levels, start, step, lambda acc: acc["d"])


def hilbert_decode(code: Column, bits: Column) -> Column:
    """STRUCT<col, row> of a Hilbert code; rebuilds the key from the lowest bit up."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("x"), zero.alias("y"), code.cast("bigint").alias("d"),
                     F.lit(1).cast("bigint").alias("s"))

    def step(acc: Column, _i: Column) -> Column:
        qx = F.shiftright(acc["d"], 1).bitwiseAND(F.lit(1).cast("bigint"))
        qy = acc["d"].bitwiseXOR(qx).bitwiseAND(F.lit(1).cast("bigint"))
        top = acc["s"] - 1
        x = F.when(qy == 1, acc["x"]).when(qx == 1, top - acc["y"]).otherwise(acc["y"])
        y = F.when(qy == 1, acc["y"]).when(qx == 1, top - acc["x"]).otherwise(acc["x"])
        return F.struct(
            (x + acc["s"] * qx).alias("x"), (y + acc["s"] * qy).alias("y"),
            F.shiftright(acc["d"], 2).alias("d"), (acc["s"] * 2).alias("s"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), bits.cast("int")), start, step,
        lambda acc: F.struct(acc["x"].alias("col"), acc["y"].alias("row")),
    )


def sfc_encode(curve: str, col: Column, row: Column, bits: Column) -> Column:
    """Curve position by curve name."""
    if curve == SFC_HILBERT:
        return hilbert_encode(col, row, bits)
    if curve == SFC_ZORDER:
        return zorder_encode(col, row)
    raise ValueError(f"unknown curve {curve!r}; use {SFC_HILBERT!r} or {SFC_ZORDER!r}")


def sfc_decode(curve: str, code: Column, bits: Column) -> Column:
    """STRUCT<col, row> by curve name."""
    if curve == SFC_HILBERT:
        return hilbert_decode(code, bits)
    if curve == SFC_ZORDER:
        return zorder_decode(code)
    raise ValueError(f"unknown curve {curve!r}; use {SFC_HILBERT!r} or {SFC_ZORDER!r}")


def pad_left(s: Column, length: int, fill: str = "0") -> Column:
    """Left-pad, keeping longer strings whole (``lpad`` would cut them)."""
    return F.when(F.length(s) >= length, s).otherwise(F.lpad(s, length, fill))


def tile_code(code: Column) -> Column:
    """Lower-case hex of a curve position, padded to eight digits."""
    return pad_left(F.lower(F.hex(code.cast("bigint"))), PAD_LENGTH)


def tile_code_value(code: Column) -> Column:
    """Curve position of a hex tile code."""
    return F.conv(code, 16, 10).cast("bigint")


# --- ranges of codes -------------------------------------------------------------------------

def position(curve: str, col: int, row: int, bits: int) -> int:
    """Code of one key, outside of Spark."""
    code = 0
    for i in range(bits - 1, -1, -1):
        x, y = col >> i & 1, row >> i & 1
        if curve == SFC_ZORDER:
            code = code << 2 | y << 1 | x
            continue
        if curve != SFC_HILBERT:
            raise ValueError(f"unknown curve {curve!r}; use {SFC_HILBERT!r} or {SFC_ZORDER!r}")
        code = code << 2 | (3 * x ^ y)
        if not y:
            flip = (1 << bits) - 1 if x else 0
            col, row = row ^ flip, col ^ flip
    return code


def code_ranges(curve: str, cols: tuple[int, int], rows: tuple[int, int], bits: int, most: int = 64) -> list[tuple[int, int]]:
    """Ascending ranges (first, last) of codes that hold every key of a rectangle of keys (ends included).

    A square of 2^k keys a side, aligned to its size, is one run of the curve.  The key space is quartered where the rectangle's border runs;
    at ``most`` ranges the squares on the border are taken whole, so ranges may hold other keys but never miss one.
    """
    (c1, c2), (r1, r2) = cols, rows
    c1, r1, c2, r2 = max(c1, 0), max(r1, 0), min(c2, (1 << bits) - 1), min(r2, (1 << bits) - 1)
    if c1 > c2 or r1 > r2:
        return []
    whole: list[tuple[int, int, int]] = []
    border = [(0, 0, bits)]
    while border and border[0][2] > 0 and len(whole) + len(border) <= most:
        finer = []
        for c, r, k in border:
            half = 1 << (k - 1)
            for x, y in ((c, r), (c + half, r), (c, r + half), (c + half, r + half)):
                if x > c2 or y > r2 or x + half <= c1 or y + half <= r1:
                    continue
                inside = x >= c1 and y >= r1 and x + half - 1 <= c2 and y + half - 1 <= r2
                (whole if inside else finer).append((x, y, k - 1))
        border = finer
    starts = sorted((position(curve, c, r, bits) >> 2 * k << 2 * k, 4 ** k) for c, r, k in whole + border)
    ranges: list[tuple[int, int]] = []
    for first, n in starts:
        if ranges and ranges[-1][1] + 1 == first:
            ranges[-1] = (ranges[-1][0], first + n - 1)
        else:
            ranges.append((first, first + n - 1))
    return ranges
