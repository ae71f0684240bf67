"""Composite jobs: tile, describe, index, query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import REGION_SIZE, SFC_HILBERT, TARGET_EPSG, TILE_SIZE
from tilequarry.functions.geometry import envelope
from tilequarry.operators import coverage as cov
from tilequarry.operators import documents, index, layout, pruning, raster, search
from tilequarry.operators.layout import TILE_KEY
from tilequarry.session import ensure_checkpoint_dir, kept


def reproject_cells(cells: DataFrame, bands: list[str], source: int, target: int, cell_size: float,
                    tile_size: int) -> DataFrame:
    """Cells on the target grid, in the same self-describing form as the input.

    Each dataset's origin is its own top-left target cell.  The moved cells are stored once, as the
    corners, the curve's size and the tiles all need them.
    """
    moved = kept(raster.reproject(cells, bands, source, target, cell_size, tile_size), "moved")
    corner = moved.groupBy("dataset_uid").agg(F.min("gx").alias("gx0"), F.min("gy").alias("gy0"))
    placed = moved.join(corner, "dataset_uid").select(
        "dataset_uid",
        (F.col("gx") - F.col("gx0")).cast("int").alias("px"), (F.col("gy") - F.col("gy0")).cast("int").alias("py"),
        (F.col("gx0") * F.lit(float(cell_size))).alias("x0"), (-F.col("gy0") * F.lit(float(cell_size))).alias("y0"),
        F.lit(float(cell_size)).alias("cell_w"), F.lit(float(cell_size)).alias("cell_h"), *bands)
    return layout.cell_center(placed)


def tile_raster(cells: DataFrame, bands: list[str], curve: str = SFC_HILBERT, tile_size: int = TILE_SIZE,
                source_epsg: int = TARGET_EPSG, target_epsg: int = TARGET_EPSG,
                cell_size: float | None = None) -> DataFrame:
    """Cells to coded tiles: reproject if needed, cut, drop negative keys, code, name."""
    if source_epsg != target_epsg:
        if cell_size is None:
            raise ValueError("a reprojection needs the target cell size")
        cells = reproject_cells(cells, bands, source_epsg, target_epsg, cell_size, tile_size)
    sizes = layout.curve_sizes(layout.cut_to_grid(cells.where("px >= 0 AND py >= 0"), tile_size))
    tiles = layout.drop_negative_keys(raster.assemble_tiles(cells, bands, tile_size))
    return layout.with_tile_code(tiles, curve, sizes)


def describe_tiles(coded_tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE,
                   checkpoint: bool = False) -> DataFrame:
    """One metadata document per tile.

    With ``checkpoint`` the tile-feature pairs are computed once and kept in the
    shared checkpoint folder.
    """
    pairs = None
    if checkpoint:
        ensure_checkpoint_dir(coded_tiles.sparkSession)
        pairs = cov.tile_features(coded_tiles, features, region_size).select(*TILE_KEY, "fid").checkpoint()
    return documents.tile_documents(coded_tiles, features, region_size, pairs=pairs)


def index_documents(docs: DataFrame) -> DataFrame:
    """Postings of documents that were read back as text."""
    return index.postings_from_documents(documents.parse_documents(docs))


def first_region(regions: DataFrame) -> DataFrame:
    """The query feature with the lowest fid, as a one-row table."""
    return regions.agg(F.min_by(F.struct("fid", "rings"), F.col("fid")).alias("f")).select("f.*")


def query_region(cells: DataFrame, tiles: DataFrame, regions: DataFrame, tile_size: int = TILE_SIZE,
                 region_size: float | None = REGION_SIZE, all_features: bool = False,
                 hits: DataFrame | None = None) -> DataFrame:
    """Cells inside the query polygon, from the tiles under it (those in ``hits`` if given).

    Uses the first feature of ``regions`` unless ``all_features``; then rows are
    per region_id.
    """
    region = regions if all_features else first_region(regions)
    spans = raster.mask_spans(tiles, region, tile_size, region_size, hits)
    return raster.mask_cells(cells, spans)


def query_region_tiles(tiles: DataFrame, regions: DataFrame, tile_size: int = TILE_SIZE,
                       region_size: float | None = REGION_SIZE, all_features: bool = False,
                       hits: DataFrame | None = None, layouts: DataFrame | None = None, curve: str = SFC_HILBERT) -> DataFrame:
    """As query_region on stored tiles of arrays: whole tiles, null outside the polygon.

    The envelope comes first: it reaches the scan as predicates on plain columns, so only
    tiles under it are opened.  The mask's runs are found from keys alone and stored, so that bands need no
    shuffle to meet them while the runs are within Spark's limit.  ``layouts`` adds datasets and runs of the curve.
    """
    region = regions if all_features else first_region(regions)
    near = pruning.tiles_under(tiles, pruning.envelope_of(region), layouts, curve)
    spans = raster.mask_spans(near, region, tile_size, region_size, hits)
    return raster.apply_runs(near, kept(raster.mask_runs(spans, tile_size), "runs"), tile_size)


def search_then_query(cells: DataFrame, tiles: DataFrame, regions: DataFrame, postings: DataFrame,
                      keywords: list[str], mode: str = "strict", all_features: bool = False,
                      tile_size: int = TILE_SIZE, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Keyword search first, then the region query on the tiles found.

    Hits prune the tiles, the mask spans of those that remain prune the cells, and
    the cells are joined once.
    """
    hits = search.search_all(postings, keywords, mode)
    return query_region(cells, tiles, regions, tile_size, region_size, all_features, hits)


def search_then_query_tiles(tiles: DataFrame, regions: DataFrame, postings: DataFrame, keywords: list[str], mode: str = "strict",
                            all_features: bool = False, tile_size: int = TILE_SIZE, region_size: float | None = REGION_SIZE,
                            layouts: DataFrame | None = None, curve: str = SFC_HILBERT) -> DataFrame:
    """Keyword search first, then the region query on the stored tiles found."""
    hits = search.search_all(postings, keywords, mode)
    return query_region_tiles(tiles, regions, tile_size, region_size, all_features, hits, layouts, curve)


@dataclass(frozen=True)
class SimpleResult:
    """Masked cells, and the features on the tiles they came from."""

    cells: DataFrame
    features: DataFrame


def simple_query(cells: DataFrame, regions: DataFrame, features: DataFrame, tile_size: int = TILE_SIZE,
                 region_size: float | None = REGION_SIZE) -> SimpleResult:
    """Without curve or index: tiles under the first region's envelope, masked, with their features."""
    region = first_region(regions)
    tiles = layout.footprints(cells, tile_size)
    extents = region.selectExpr("fid AS query_id", f"inline(array({envelope('rings')}))")
    near = cov.tiles_in_extents(tiles, extents, region_size).drop("query_id")
    spans = raster.mask_spans(near, region, tile_size, region_size)
    return SimpleResult(
        cells=raster.mask_cells(cells, spans),
        features=cov.features_on_tiles(near, features, region_size),
    )


def clip_metadata(tiles: DataFrame, features: DataFrame, regions: DataFrame, filter_first: bool = True,
                  bin_size: float | None = None, region_size: float | None = REGION_SIZE) -> DataFrame:
    """Features clipped to the tiles; only those that meet the first region if ``filter_first``."""
    from tilequarry.operators.features import clip_to_tiles

    if filter_first:
        if bin_size is None:
            raise ValueError("filtering needs a bin size")
        met = cov.features_intersect(features, first_region(regions), bin_size)
        features = features.join(met.select(F.col("left_fid").alias("fid")), "fid", "left_semi")
    return clip_to_tiles(tiles, features, region_size)
