"""Grids and layouts: cutting cells to a grid, footprints, layer metadata.

``cells`` rows are self-describing: ``dataset_uid, px, py, x0, y0, cell_w,
cell_h, b1..bN``, where (x0, y0) is the dataset's top-left corner and rows count
down.  ``tiles`` rows carry ``dataset_uid, col, row_, xmin, ymin, xmax, ymax``
and the dataset's origin ``x0, y0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import SFC_HILBERT, TILE_SIZE
from tilequarry.functions import scalars, sfc
from tilequarry.functions.geometry import box_ring

TILE_KEY = ["dataset_uid", "col", "row_"]
EXTENT = ["xmin", "ymin", "xmax", "ymax"]


def cell_center(cells: DataFrame) -> DataFrame:
    """Add cx, cy, the map position of each cell's centre."""
    return cells.withColumns({
        "cx": F.col("x0") + (F.col("px") + F.lit(0.5)) * F.col("cell_w"),
        "cy": F.col("y0") - (F.col("py") + F.lit(0.5)) * F.col("cell_h"),
    })


def cut_to_grid(cells: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Add the key of the tile each cell falls in."""
    return cells.withColumns({
        "col": F.floor(F.col("px") / F.lit(float(tile_size))).cast("int"),
        "row_": F.floor(F.col("py") / F.lit(float(tile_size))).cast("int"),
    })


def key_extent(tiles: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Add the map rectangle of each tile key; rows count down from y0."""
    w = F.col("cell_w") * tile_size
    h = F.col("cell_h") * tile_size
    return tiles.withColumns({
        "xmin": F.col("x0") + F.col("col") * w,
        "xmax": F.col("x0") + (F.col("col") + 1) * w,
        "ymax": F.col("y0") - F.col("row_") * h,
        "ymin": F.col("y0") - (F.col("row_") + 1) * h,
    })


def footprints(cells: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """One row per tile that holds a cell: key, rectangle, origin, cell count.

    Reads no band, and the count is combined before the shuffle.
    """
    keys = cut_to_grid(cells.select("dataset_uid", "px", "py", "x0", "y0", "cell_w", "cell_h"), tile_size)
    grouped = keys.groupBy(*TILE_KEY, "x0", "y0", "cell_w", "cell_h").agg(F.count("*").alias("n_cells"))
    return key_extent(grouped, tile_size).withColumns({
        "tile_w": F.col("cell_w") * tile_size, "tile_h": F.col("cell_h") * tile_size,
    })


def drop_negative_keys(tiles: DataFrame) -> DataFrame:
    """Tiles left of or above the origin have no curve position."""
    return tiles.where((F.col("col") >= 0) & (F.col("row_") >= 0))


def curve_sizes(tiles: DataFrame) -> DataFrame:
    """Bits per axis of each dataset's curve, from its largest column and row."""
    return tiles.groupBy("dataset_uid").agg(
        sfc.curve_bits(F.max("col"), F.max("row_")).alias("bits")
    )


def with_tile_code(tiles: DataFrame, curve: str = SFC_HILBERT, sizes: DataFrame | None = None) -> DataFrame:
    """Add sfc, tile_code and file_name.  Keys must not be negative.

    ``sizes`` has one row per dataset; it is taken from ``tiles`` if not given.
    """
    if curve == SFC_HILBERT:
        coded = tiles.join(curve_sizes(tiles) if sizes is None else sizes, "dataset_uid")
    else:
        coded = tiles.withColumn("bits", F.lit(31))
    coded = coded.withColumn("sfc", sfc.sfc_encode(curve, F.col("col"), F.col("row_"), F.col("bits")))
    coded = coded.withColumn("tile_code", sfc.tile_code(F.col("sfc")))
    return coded.withColumn(
        "file_name",
        scalars.tile_file_name(F.col("dataset_uid"), F.col("tile_code"), F.col("col"), F.col("row_")),
    ).drop("bits")


def layout_metadata(cells: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Layer metadata per dataset from its cells: extent, key bounds, cell count."""
    cut = cut_to_grid(cells.select("dataset_uid", "px", "py", "x0", "y0", "cell_w", "cell_h"), tile_size)
    per_layer = cut.groupBy("dataset_uid", "x0", "y0", "cell_w", "cell_h").agg(
        F.count("*").alias("n_cells"),
        F.min("col").alias("min_col"), F.min("row_").alias("min_row"),
        F.max("col").alias("max_col"), F.max("row_").alias("max_row"),
    )
    w, h = F.col("cell_w") * tile_size, F.col("cell_h") * tile_size
    return per_layer.select(
        "dataset_uid", "n_cells", "cell_w", "cell_h", "min_col", "min_row", "max_col", "max_row",
        (F.col("x0") + F.col("min_col") * w).alias("xmin"),
        (F.col("y0") - (F.col("max_row") + 1) * h).alias("ymin"),
        (F.col("x0") + (F.col("max_col") + 1) * w).alias("xmax"),
        (F.col("y0") - F.col("min_row") * h).alias("ymax"),
    )


def layout_from_names(tiles: DataFrame, tile_size: int = TILE_SIZE) -> DataFrame:
    """Rebuild layer metadata from tile file names and stored tile extents.

    The cell size is measured from the tiles, so a partial set of tiles keeps its
    place on the grid.
    """
    parsed = tiles.select(*EXTENT, *[c.alias(n) for n, c in scalars.parse_tile_name(F.col("file_name")).items()])
    return parsed.groupBy("dataset_uid").agg(
        F.count("*").alias("n_tiles"),
        F.min("col").alias("min_col"), F.min("row_").alias("min_row"),
        F.max("col").alias("max_col"), F.max("row_").alias("max_row"),
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        (F.max(F.col("xmax") - F.col("xmin")) / tile_size).alias("cell_w"),
        (F.max(F.col("ymax") - F.col("ymin")) / tile_size).alias("cell_h"),
    )


COMPARED_FIELDS = ["cell_h", "cell_w", "max_col", "max_row", "min_col", "min_row",
                   "xmax", "xmin", "ymax", "ymin"]


def compare_layouts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Field-by-field comparison of two layout tables, missing datasets included."""
    def long_form(layouts: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in COMPARED_FIELDS
        ])
        return layouts.select("dataset_uid", F.inline(entries))

    both = long_form(left, "left_value").join(long_form(right, "right_value"), ["dataset_uid", "field"], "full")
    return both.withColumn("is_equal", F.col("left_value").eqNullSafe(F.col("right_value")))


def tile_outlines(tiles: DataFrame) -> DataFrame:
    """Each tile's rectangle as a polygon."""
    return tiles.select(*TILE_KEY, F.expr(f"array({box_ring(*EXTENT)})").alias("rings"))


def covering_range(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """First and last index of the half-open cells [i*size, (i+1)*size) that an interval
    starting at the grid's origin covers; its own upper end is exclusive."""
    return F.floor(low / size), F.greatest(F.ceil(high / size) - 1, F.floor(low / size))


def covering_keys(extents: DataFrame, layout: DataFrame) -> DataFrame:
    """All keys of a layout that each extent covers, clipped to the layout's size.

    ``layout`` has one row: x0, y0, tile_w, tile_h, n_cols, n_rows.
    """
    def of(name: str) -> Column:
        return layout.select(name).scalar()

    grid = extents.withColumns({c: of(c) for c in ("x0", "y0", "tile_w", "tile_h", "n_cols", "n_rows")})
    c_low, c_high = covering_range(F.col("xmin") - F.col("x0"), F.col("xmax") - F.col("x0"), F.col("tile_w"))
    r_low, r_high = covering_range(F.col("y0") - F.col("ymax"), F.col("y0") - F.col("ymin"), F.col("tile_h"))
    keyed = grid.withColumns({
        "c_low": F.greatest(c_low, F.lit(0)), "c_high": F.least(c_high, F.col("n_cols") - 1),
        "r_low": F.greatest(r_low, F.lit(0)), "r_high": F.least(r_high, F.col("n_rows") - 1),
    }).where("c_low <= c_high AND r_low <= r_high")
    by_row = keyed.withColumn("row_", F.explode(F.sequence("r_low", "r_high")))
    return by_row.withColumn("col", F.explode(F.sequence("c_low", "c_high"))).select(
        *extents.columns, F.col("col").cast("int").alias("col"), F.col("row_").cast("int").alias("row_")
    )


def curve_order(tiles: DataFrame, block_bits: int = 12) -> DataFrame:
    """Number the tiles of each dataset along the curve, from 1.

    The rank is the number of tiles in earlier blocks of the curve plus the rank
    within the tile's own block.  A block holds at most 2^block_bits tiles, so no
    task ever sorts a whole dataset.
    """
    from pyspark.sql import Window

    blocked = tiles.withColumn("block", F.shiftright("sfc", block_bits))
    sizes = blocked.groupBy("dataset_uid", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dataset_uid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("dataset_uid", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("dataset_uid", "block").orderBy("sfc")
    ranked = blocked.withColumn("rank_in_block", F.row_number().over(within)).join(starts, ["dataset_uid", "block"])
    return ranked.withColumn("pos", F.col("start") + F.col("rank_in_block")).drop("block", "start", "rank_in_block")


def stored_layouts(tiles: DataFrame) -> DataFrame:
    """What a query needs to know of each dataset before it opens a tile: grid, key bounds, extent, bits of its curve.

    From coded tiles, stored or not; reads no band.
    """
    return tiles.groupBy("dataset_uid").agg(
        *[F.min(c).alias(c) for c in ("x0", "y0", "tile_w", "tile_h")], F.count("*").alias("n_tiles"),
        F.min("col").alias("min_col"), F.min("row_").alias("min_row"), F.max("col").alias("max_col"), F.max("row_").alias("max_row"),
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        sfc.curve_bits(F.max("col"), F.max("row_")).alias("bits"))
