"""Many scenes as one layer: a common grid, re-keying, and merging of what overlaps.

``headers`` rows say what is known of a scene before its cells are read: ``dataset_uid, x0, y0,
cell_w, cell_h, nx, ny`` and optionally ``epsg``.  A *fragment* is a rectangle of cells of one band
inside one tile: tile key and origin, ``scene``, ``band`` (from 1), place ``lx, ly``, shape ``w, h`` and
``vals``, row by row; NODATA is null.  Where scenes overlap, the first by name with a value wins, band by band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import SFC_HILBERT, TILE_SIZE
from tilequarry.functions import sfc
from tilequarry.operators import layout, raster
from tilequarry.operators.layout import TILE_KEY
from tilequarry.operators.raster import ORIGIN
from tilequarry.session import kept

# How far, in cells, an origin may be from the common grid.
TOLERANCE = 1e-6


def scene_headers(cells: DataFrame) -> DataFrame:
    """Headers from cells; no band is read."""
    epsg = ["epsg"] if "epsg" in cells.columns else []
    return cells.groupBy("dataset_uid", *ORIGIN, *epsg).agg(
        (F.max("px") + 1).alias("nx"), (F.max("py") + 1).alias("ny"))


def common_grid(headers: DataFrame, layer: str, tile_size: int = TILE_SIZE) -> DataFrame:
    """One row: the grid that all scenes fit, from the left and top of all, and its size in tiles.

    The job fails if cell sizes or projections differ; such scenes are reprojected or resampled first.
    """
    def one(name: str, same: Column) -> Column:
        message = F.lit(f"scenes of one layer need one {name}; reproject or resample them first")
        return F.when(~same, F.raise_error(message)).otherwise(F.min(name)).alias(name)

    def near(name: str) -> Column:
        return F.max(name) - F.min(name) <= F.min(name) * TOLERANCE

    epsg = [one("epsg", F.min("epsg") == F.max("epsg"))] if "epsg" in headers.columns else []
    whole = headers.agg(
        F.min("x0").alias("x0"), F.max("y0").alias("y0"), one("cell_w", near("cell_w")), one("cell_h", near("cell_h")), *epsg,
        F.max(F.col("x0") + F.col("nx") * F.col("cell_w")).alias("right"),
        F.min(F.col("y0") - F.col("ny") * F.col("cell_h")).alias("bottom"), F.count("*").alias("n_scenes")).where("n_scenes > 0")
    return whole.select(
        F.lit(layer).alias("dataset_uid"), *ORIGIN, *(["epsg"] if epsg else []), "n_scenes",
        F.ceil(F.round((F.col("right") - F.col("x0")) / F.col("cell_w")) / tile_size).cast("int").alias("n_cols"),
        F.ceil(F.round((F.col("y0") - F.col("bottom")) / F.col("cell_h")) / tile_size).cast("int").alias("n_rows"))


def on_grid(rows: DataFrame, grid: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """Cells, blocks or anything else with a place (x, y) in its scene, re-keyed to the grid.

    The scene's name moves to ``scene`` and the layer's takes its place.  A scene that is not a
    whole number of cells away from the grid's corner fails the job.
    """
    fields = ["dataset_uid", *ORIGIN]
    placed = rows.withColumn("grid_", grid.select(F.struct(*fields).alias("g")).scalar())
    g = {f: F.col("grid_")[f] for f in fields}

    def shift(distance: Column, size: Column) -> Column:
        steps = distance / size
        whole = F.round(steps)
        off = F.raise_error(F.concat(F.lit("not on the grid of the layer: "), F.col("dataset_uid"))).cast("int")
        return F.when(F.abs(steps - whole) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(steps) / 1e6), whole.cast("int")).otherwise(off)

    moved = placed.withColumns({
        x: F.col(x) + shift(F.col("x0") - g["x0"], g["cell_w"]), y: F.col(y) + shift(g["y0"] - F.col("y0"), g["cell_h"]),
        "scene": F.col("dataset_uid")})
    return moved.withColumns(g).drop("grid_")


def grid_sizes(grid: DataFrame) -> DataFrame:
    """Bits of the layer's curve, for ``layout.with_tile_code``."""
    return grid.select("dataset_uid", sfc.curve_bits(F.col("n_cols") - 1, F.col("n_rows") - 1).alias("bits"))


def layer_from_scenes(cells: DataFrame, bands: list[str], layer: str, curve: str = SFC_HILBERT, tile_size: int = TILE_SIZE,
                      headers: DataFrame | None = None) -> DataFrame:
    """The coded tiles of one layer from the cells of all scenes, merged in the shuffle that assembles them.

    ``headers`` saves a pass over the keys where they are known, as from GeoTIFF headers.
    """
    grid = kept(common_grid(scene_headers(cells) if headers is None else headers, layer, tile_size), "grid")
    tiles = raster.assemble_tiles(on_grid(cells, grid), bands, tile_size, first_by="scene")
    return layout.with_tile_code(tiles, curve, grid_sizes(grid))


# --- fragments -------------------------------------------------------------------------------

def assemble_fragments(fragments: DataFrame, n_bands: int, tile_size: int = TILE_SIZE) -> DataFrame:
    """Fragments to tiles: arrays, not cells, go through the one shuffle.

    Inside it fragments become strips of one row, strips that overlap are merged by the order of
    their scenes, and strips become a tile.  Bands and cells that nothing covers are null.
    """
    ts = int(tile_size)
    moved = fragments.select(*TILE_KEY, *ORIGIN, "scene", "band", "lx", "ly", "w", "h", "vals").repartition(*TILE_KEY)
    strips = moved.selectExpr(
        *TILE_KEY, *ORIGIN, "band", "scene", "lx", "ly", "w", "vals", "explode(sequence(0, h - 1)) AS i"
    ).selectExpr(*TILE_KEY, *ORIGIN, "band", "int(ly + i) AS ly", "struct(scene, lx, slice(vals, i * w + 1, w) AS v) AS part")
    gap = "array_repeat(CAST(NULL AS DOUBLE), int({}))"
    wide = f"concat({gap.format('p.lx')}, p.v, {gap.format(f'{ts} - p.lx - size(p.v)')})"
    merged = (f"aggregate(slice(parts, 2, size(parts)), transform(slice(parts, 1, 1), p -> {wide})[0], "
              f"(acc, p) -> zip_with(acc, {wide}, (a, b) -> coalesce(a, b)))")
    origin = [F.min(c).alias(c) for c in ORIGIN]
    rows = strips.groupBy(*TILE_KEY, "band", "ly").agg(F.expr("sort_array(collect_list(part)) AS parts"), *origin).select(
        *TILE_KEY, *ORIGIN, "band", F.struct("ly", F.expr(merged).alias("v")).alias("strip"))
    empty = F.array_repeat(F.lit(None).cast("double"), ts)
    planes = rows.groupBy(*TILE_KEY, "band").agg(F.sort_array(F.collect_list("strip")).alias("strips"), *origin).select(
        *TILE_KEY, *ORIGIN, "band", F.flatten(raster.spread("strips", "ly", F.lit(ts), lambda r: r["v"], empty)).alias("plane"))
    found = planes.groupBy(*TILE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("band", "plane"))).alias("m"), *origin)
    nothing = gap.format(ts * ts)
    tiles = found.select(*TILE_KEY, *ORIGIN, F.expr(
        f"transform(sequence(1, {int(n_bands)}), i -> coalesce(try_element_at(m, i), {nothing})) AS bands"))
    return layout.key_extent(tiles, ts).withColumns({"tile_w": F.col("cell_w") * ts, "tile_h": F.col("cell_h") * ts})


def layer_from_fragments(fragments: DataFrame, n_bands: int, grid: DataFrame, curve: str = SFC_HILBERT,
                         tile_size: int = TILE_SIZE) -> DataFrame:
    """The coded tiles of one layer from fragments already on its grid."""
    return layout.with_tile_code(assemble_fragments(fragments, n_bands, tile_size), curve, grid_sizes(grid))


def _parts(tiles: DataFrame, tile_size: int) -> DataFrame:
    """The up to four tiles of the grid that a re-keyed tile lies on: key t_col, t_row, the corner (sx, sy) and the
    shape (w, h) of the part, and its place (lx, ly)."""
    ts = int(tile_size)

    def axis(at: str, key: str, s: str, n: str, to: str) -> str:
        first = f"struct(int(floor({at} / {ts})) AS {key}, 0 AS {s}, int({ts} - pmod({at}, {ts})) AS {n}, int(pmod({at}, {ts})) AS {to})"
        second = f"struct(int(floor({at} / {ts})) + 1 AS {key}, int({ts} - pmod({at}, {ts})) AS {s}, int(pmod({at}, {ts})) AS {n}, 0 AS {to})"
        return f"inline(if(pmod({at}, {ts}) = 0, array({first}), array({first}, {second})))"

    across = tiles.selectExpr("*", axis("px", "t_col", "sx", "w", "lx"))
    return across.selectExpr("*", axis("py", "t_row", "sy", "h", "ly"))


def mosaic_tiles(tiles: DataFrame, n_bands: int, layer: str, tile_size: int = TILE_SIZE) -> DataFrame:
    """Stored tiles of several datasets as the tiles of one layer.

    Which tiles meet is found from keys alone and stored.  A tile that lies on the grid and meets no
    other is renamed where it is read; only the others are cut to fragments, shuffled and merged.
    Tiles without a value are left out.
    """
    ts = int(tile_size)
    # A tile's own corner in its dataset, and the datasets as headers of whole tiles.
    placed = tiles.withColumns({"px": F.col("col") * ts, "py": F.col("row_") * ts})
    headers = placed.groupBy("dataset_uid", *ORIGIN).agg((F.max("px") + ts).alias("nx"), (F.max("py") + ts).alias("ny"))
    grid = kept(common_grid(headers, layer, ts), "grid")
    source = ["scene", "col", "row_"]

    keys = _parts(on_grid(placed.select(*TILE_KEY, *ORIGIN, "px", "py"), grid), ts)
    alone = kept(
        keys.groupBy("t_col", "t_row").agg(
            F.count("*").alias("n"), F.min(F.struct(*source)).alias("s"), F.min((F.col("w") == ts) & (F.col("h") == ts)).alias("whole"))
        .where("n = 1 AND whole").selectExpr("s.scene", "s.col", "s.row_", "t_col", "t_row"), "alone")

    moved = on_grid(placed.select(*TILE_KEY, *ORIGIN, "px", "py", "bands"), grid)
    has = "exists({}, v -> v IS NOT NULL)"
    untouched = moved.join(alone, source).where(f"exists(bands, b -> {has.format('b')})").select(
        "dataset_uid", F.col("t_col").alias("col"), F.col("t_row").alias("row_"), *ORIGIN, "bands")
    planes = moved.join(alone, source, "left_anti").selectExpr(
        "dataset_uid", "scene", *ORIGIN, "px", "py", "posexplode(bands) AS (b, plane)")
    cut = f"flatten(transform(sequence(sy, sy + h - 1), i -> slice(plane, i * {ts} + sx + 1, w)))"
    fragments = _parts(planes, ts).selectExpr(
        "dataset_uid", "t_col AS col", "t_row AS row_", *ORIGIN, "scene", "int(b + 1) AS band", "lx", "ly", "w", "h", f"{cut} AS vals"
    ).where(has.format("vals"))
    merged = assemble_fragments(fragments, n_bands, ts)
    extent = {"tile_w": F.col("cell_w") * ts, "tile_h": F.col("cell_h") * ts}
    return layout.key_extent(untouched, ts).withColumns(extent).unionByName(merged)
