"""Kernels over whole tiles: neighbours send their borders, not their cells.

A kernel that looks one cell to the right and down needs, beside its own tile, the first column of the tile to the
right, the first row of the one below and one corner.  Only these borders are shuffled apart from the tiles;
no row is made for a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import TILE_SIZE
from tilequarry.operators.layout import TILE_KEY


def borders(tiles: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """What each tile's right, lower and diagonal neighbours send it: ``h_right``, ``h_below``, ``h_corner``, band by band.

    A side without a neighbour is null.
    """
    ts = int(tile_size)
    sent = tiles.selectExpr("dataset_uid", f"""inline(array(
        struct(int(col - 1) AS col, int(row_) AS row_, 0 AS side, transform(bands, b -> transform(sequence(0, {ts - 1}), y -> b[y * {ts}])) AS edge),
        struct(int(col) AS col, int(row_ - 1) AS row_, 1 AS side, transform(bands, b -> slice(b, 1, {ts})) AS edge),
        struct(int(col - 1) AS col, int(row_ - 1) AS row_, 2 AS side, transform(bands, b -> slice(b, 1, 1)) AS edge)))""")
    return sent.groupBy(*TILE_KEY).agg(*[
        F.expr(f"any_value(edge) FILTER (WHERE side = {i})").alias(n) for i, n in enumerate(("h_right", "h_below", "h_corner"))])


def with_halo(tiles: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Add ``planes``: for each band tile_size + 1 rows of tile_size + 1 cells, the last of each from the neighbours."""
    ts = int(tile_size)
    gap = f"array_repeat(CAST(NULL AS DOUBLE), {ts})"
    met = tiles.join(borders(tiles, ts), TILE_KEY, "left")
    planes = f"""transform(bands, (band, i) -> concat(
        transform(sequence(0, {ts - 1}), y -> concat(slice(band, y * {ts} + 1, {ts}), array(h_right[i][y]))),
        array(concat(coalesce(h_below[i], {gap}), array(h_corner[i][0])))))"""
    return met.withColumn("planes", F.expr(planes)).drop("h_right", "h_below", "h_corner")


def resample_bilinear_tiles(tiles: DataFrame, dx: float, dy: float, tile_size: int = TILE_SIZE) -> DataFrame:
    """Each tile's values at (px + dx, py + dy) in cell units, 0 <= dx, dy < 1.

    Neighbours without a value are left out and the weights rescaled; where none has one the value is null.
    """
    if not (0 <= dx < 1 and 0 <= dy < 1):
        raise ValueError("offsets must be in [0, 1)")
    ts = int(tile_size)
    near = [(f"p[y + {j}][x + {i}]", float((dx if i else 1 - dx) * (dy if j else 1 - dy))) for j in (0, 1) for i in (0, 1)]
    near = [(at, w) for at, w in near if w > 0]
    total = " + ".join(f"coalesce({at} * {w!r}D, 0D)" for at, w in near)
    weight = " + ".join(f"if({at} IS NULL, 0D, {w!r}D)" for at, w in near)
    some = " OR ".join(f"{at} IS NOT NULL" for at, _ in near)
    value = f"if({some}, ({total}) / ({weight}), CAST(NULL AS DOUBLE))"
    cells = f"flatten(transform(sequence(0, {ts - 1}), y -> transform(sequence(0, {ts - 1}), x -> {value})))"
    return with_halo(tiles, ts).withColumn("bands", F.expr(f"transform(planes, p -> {cells})")).drop("planes")
