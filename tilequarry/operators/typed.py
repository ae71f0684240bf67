"""Cell type and projection of stored tiles.

Cells are stored in the narrowest array type that holds their cell type: Spark keeps such an array as packed values
with a bitmap of nulls, which is where cells without a value are, so no number is set apart for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import TILE_SIZE
from tilequarry.operators.layout import EXTENT

# Cell type, type of the stored array, least and greatest whole value (None: not whole).
CELL_TYPES = {
    "int8": ("tinyint", -128, 127),
    "uint8": ("smallint", 0, 255),
    "int16": ("smallint", -32768, 32767),
    "uint16": ("int", 0, 65535),
    "int32": ("int", -2147483648, 2147483647),
    "float32": ("float", None, None),
    "float64": ("double", None, None),
}
LAYER_FIELDS = ["cell_h", "cell_type", "cell_w", "epsg", "max_col", "max_row", "min_col", "min_row", "tile_size",
                "xmax", "xmin", "ymax", "ymin"]


def with_cell_type(tiles: DataFrame, cell_type: str, epsg: int, tile_size: int = TILE_SIZE) -> DataFrame:
    """Tiles with bands of a cell type, and columns ``cell_type``, ``epsg`` and ``tile_size``.

    A value that a whole type cannot hold fails the job; float32 rounds.
    """
    if cell_type not in CELL_TYPES:
        raise ValueError(f"unknown cell type {cell_type!r}; use one of {sorted(CELL_TYPES)}")
    stored, low, high = CELL_TYPES[cell_type]
    value = f"CAST(v AS {stored})"
    if low is not None:
        value = f"""CASE WHEN v IS NULL OR (v >= {low} AND v <= {high} AND v = floor(v)) THEN {value}
            ELSE CAST(raise_error(concat('no {cell_type}: ', v)) AS {stored}) END"""
    return tiles.withColumns({
        "bands": F.expr(f"transform(bands, b -> transform(b, v -> {value}))"),
        "cell_type": F.lit(cell_type), "epsg": F.lit(int(epsg)), "tile_size": F.lit(int(tile_size))})


def as_doubles(tiles: DataFrame) -> DataFrame:
    """Tiles of any cell type with bands of doubles, as the raster operators take them."""
    return tiles.withColumn("bands", F.col("bands").cast("array<array<double>>"))


def layer_metadata(tiles: DataFrame) -> DataFrame:
    """Per dataset: projection, cell type, tile size, cell size, key bounds, extent.  Reads no band.

    A dataset with two projections, cell types or tile sizes fails the job.
    """
    def only(name: str):
        mixed = F.raise_error(F.concat(F.lit(f"mixed {name} in dataset "), F.first("dataset_uid")))
        return F.when(F.min(name).eqNullSafe(F.max(name)), F.min(name)).otherwise(mixed).alias(name)

    return tiles.groupBy("dataset_uid").agg(
        only("epsg"), only("cell_type"), only("tile_size"), F.count("*").alias("n_tiles"),
        (F.min("tile_w") / F.min("tile_size")).alias("cell_w"), (F.min("tile_h") / F.min("tile_size")).alias("cell_h"),
        *[F.min(k).alias(n) for k, n in (("col", "min_col"), ("row_", "min_row"))],
        *[F.max(k).alias(n) for k, n in (("col", "max_col"), ("row_", "max_row"))],
        *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in EXTENT])


def compare_layers(left: DataFrame, right: DataFrame) -> DataFrame:
    """(dataset_uid, field, left_value, right_value, is_equal): every field as text; a missing dataset's values are null."""
    def long_form(layers: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in LAYER_FIELDS])
        return layers.select("dataset_uid", F.inline(entries))

    both = long_form(left, "left_value").join(long_form(right, "right_value"), ["dataset_uid", "field"], "full")
    return both.withColumn("is_equal", F.col("left_value").eqNullSafe(F.col("right_value")))
