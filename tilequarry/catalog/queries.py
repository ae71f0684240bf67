"""Registered queries: name -> function of (spark, sf_dir).

Each runs an operator over whole tables.  Columns are named as in oracle.py.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry import fixtures as fx
from tilequarry.functions import geometry as geo
from tilequarry.functions import projection, scalars, sfc
from tilequarry.operators import coverage as cov
from tilequarry.operators import bitmaps, documents, features as ft, halo, index, layout, raster, scenes, search, typed
from tilequarry.plans import pipelines
from tilequarry.session import ensure_checkpoint_dir
from tilequarry.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = layout.TILE_KEY
BANDS = ["b1", "b2"]
KEYWORDS = ["nation", "seg_building"]
TAGS = ["acctbal", ">=", "1000", "nation", "<", "15", "Block_Name", "contains", "B1"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def coded_tiles(spark: SparkSession, d: str) -> DataFrame:
    return layout.with_tile_code(fx.tiles(spark, d))


def tile_attributes(spark: SparkSession, d: str) -> DataFrame:
    return documents.tile_attributes(fx.tiles(spark, d), fx.features(spark, d), fx.REGION)


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.build_postings(tile_attributes(spark, d))


def doc_postings(spark: SparkSession, d: str) -> DataFrame:
    tiles = coded_tiles(spark, d).select(
        *KEY, "tile_code", scalars.path_join("json", scalars.doc_name(F.col("file_name"))).alias("doc_path"))
    return postings(spark, d).join(tiles, KEY).select("kw", "doc_path", "tile_code", "dataset_uid")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_layer(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The tiles of the given tables, stored as a layer in the shared folder and read back with their layouts."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/layer-{uuid.uuid4().hex}"
    tables.write_layer(pipelines.tile_raster(fx.cells(spark, d), BANDS, tile_size=fx.TILE), folder)
    return tables.read_layer(spark, folder)


def tile_sums(tiles: DataFrame, *keys: str) -> DataFrame:
    """Cells with a value in the last band, and each band's sum."""
    present = [F.filter(F.element_at("bands", i + 1), lambda v: v.isNotNull()) for i in range(len(BANDS))]
    return tiles.select(*keys, *KEY, F.size(present[-1]).cast("bigint").alias("n_kept"),
                        *[F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("sum_" + b) for b, v in zip(BANDS, present)])


# --- sources ---------------------------------------------------------------------------------

@query
def scan_cells(spark, d):
    return fx.cells(spark, d).select("dataset_uid", "px", "py", "cx", "cy", *BANDS)


@query
def scan_tiles(spark, d):
    return fx.tiles(spark, d).select(*KEY, *layout.EXTENT, "n_cells")


@query
def scan_features(spark, d):
    return fx.features(spark, d).select(
        "fid", "geom_type", F.size("rings").cast("bigint").alias("n_rings"),
        F.expr(geo.vertex_count("rings")).alias("n_vertices"),
        ft.attribute("Block_Name").alias("block_name"), ft.attribute("UID", "bigint").alias("uid"),
        F.size("attrs").cast("bigint").alias("n_attrs"))


@query
def features_by_geom_type(spark, d):
    kinds = [k for k in ft.GEOMETRY_KINDS if k != "MultiPolygon"]
    return ft.of_kind(fx.mixed_geometries(spark, d), *kinds).select(
        "fid", "geom_type", F.expr(geo.vertex_count("rings")).alias("n_vertices"))


@query
def features_single_attr(spark, d):
    return ft.single_attribute(
        fx.mixed_geometries(spark, d), ft.GEOMETRY_KINDS, "acctbal", "double").select("fid", "geom_type", "value")


@query
def scan_tile_docs(spark, d):
    docs = documents.tile_documents(coded_tiles(spark, d), fx.features(spark, d), fx.REGION)
    parsed = documents.parse_documents(docs)
    return parsed.groupBy("doc_path", "dataset_uid", "tile_code").agg(
        F.count("*").alias("n_features"), F.sum(F.size("attrs")).alias("n_values"))


@query
def index_load_text(spark, d):
    return index.load_text(index.render_text(doc_postings(spark, d)))


# --- sinks -----------------------------------------------------------------------------------

@query
def tile_file_names(spark, d):
    return coded_tiles(spark, d).select(
        *KEY, "tile_code", "file_name", scalars.path_join("tiles", F.col("file_name")).alias("tile_path"))


@query
def index_render_text(spark, d):
    return index.render_text(doc_postings(spark, d))


@query
def features_to_geojson(spark, d):
    return ft.to_geojson(fx.features(spark, d), "Block_Name")


@query
def features_flatten(spark, d):
    columns = {"Block_Name": "string", "UID": "bigint", "acctbal": "double", "nation": "int"}
    return ft.flatten_attributes(fx.features(spark, d), columns, fx.EPSG).drop("rings")


# --- projections -----------------------------------------------------------------------------

@query
def tile_name_parse(spark, d):
    names = coded_tiles(spark, d).select("file_name")
    return names.select("file_name", *[c.alias(n) for n, c in scalars.parse_tile_name(F.col("file_name")).items()])


@query
def doc_path_rewrite(spark, d):
    name = scalars.doc_name(F.col("file_name"))
    root = F.when(F.col("col") % 2 == 0, "file:/data/tiles").otherwise("hdfs://host:9000/tiles")
    uri = scalars.path_join(root, "json", name)
    docs = coded_tiles(spark, d).select(*KEY, uri.alias("doc_uri"))
    path = scalars.strip_scheme(F.col("doc_uri"))
    return docs.select(*KEY, "doc_uri", path.alias("doc_path"), scalars.doc_to_tile_path(path).alias("tile_path"))


@query
def key_to_extent(spark, d):
    keys = fx.cells(spark, d).select(*KEY, *raster.ORIGIN).distinct()
    return layout.key_extent(keys, fx.TILE).select(*KEY, *layout.EXTENT)


@query
def feature_envelope(spark, d):
    return ft.envelopes(fx.features(spark, d))


@query
def tile_outlines(spark, d):
    outline = layout.tile_outlines(fx.tiles(spark, d))
    return outline.select(*KEY, F.posexplode(F.element_at("rings", 1)).alias("vertex", "p")).select(
        *KEY, "vertex", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


# --- filters ---------------------------------------------------------------------------------

@query
def drop_negative_keys(spark, d):
    shifted = fx.tiles(spark, d).withColumns({"col": F.col("col") - 2, "row_": F.col("row_") - 2})
    return layout.drop_negative_keys(shifted).select(*KEY)


@query
def polygon_intersects_tile(spark, d):
    return cov.tile_features(fx.tiles(spark, d), fx.regions(spark, d), fx.REGION).select(
        F.col("fid").alias("region_id"), *KEY, "is_inside")


@query
def features_intersect_region(spark, d):
    return cov.features_intersect(fx.features(spark, d), fx.regions(spark, d), fx.BIN).select(
        F.col("left_fid").alias("fid"), F.col("right_fid").alias("region_id"))


@query
def tiles_in_extent(spark, d):
    extents = ft.envelopes(fx.regions(spark, d)).withColumnRenamed("fid", "query_id")
    return cov.tiles_in_extents(fx.tiles(spark, d), extents, fx.REGION).select(
        F.col("query_id").alias("region_id"), *KEY)


@query
def filter_by_suffix(spark, d):
    tile_names = coded_tiles(spark, d).select(F.col("file_name").alias("name"))
    names = tile_names.union(tile_names.select(scalars.doc_name(F.col("name"))))
    return names.where(scalars.has_suffix(F.col("name"), ["tif"]))


@query
def tag_value_search(spark, d):
    return search.search_values(tile_attributes(spark, d), search.parse_tags(TAGS))


@query
def extent_covering_keys(spark, d):
    size = fx.TILE * fx.CELL
    whole = fx.tiles(spark, d).agg(
        F.min("xmin").alias("x0"), F.max("ymax").alias("y0"),
        F.lit(size).alias("tile_w"), F.lit(size).alias("tile_h"),
        F.ceil((F.max("xmax") - F.min("xmin")) / size).alias("n_cols"),
        F.ceil((F.max("ymax") - F.min("ymin")) / size).alias("n_rows"))
    return layout.covering_keys(ft.envelopes(fx.features(spark, d)), whole).select("fid", "col", "row_")


# --- joins -----------------------------------------------------------------------------------

@query
def tile_feature_join(spark, d):
    return cov.tiles_with_features(fx.tiles(spark, d), fx.features(spark, d), fx.REGION).select(*KEY, "fid")


@query
def tile_feature_join_inner(spark, d):
    return cov.tile_features(fx.tiles(spark, d), fx.features(spark, d), fx.REGION).select(*KEY, "fid")


@query
def tile_metadata_docs(spark, d):
    return documents.tile_documents(coded_tiles(spark, d), fx.features(spark, d), fx.REGION)


@query
def tile_document_lines(spark, d):
    """Tile documents written as lines, a folder each, and read back."""
    folder = new_folder(spark, "documents")
    tables.write_document_lines(documents.document_lines(coded_tiles(spark, d), fx.features(spark, d), fx.REGION), folder)
    return tables.read_document_lines(spark, folder)


@query
def features_on_tiles(spark, d):
    hit = cov.features_on_tiles(fx.tiles(spark, d), fx.features(spark, d), fx.REGION)
    return hit.select("fid", F.to_json("attrs").alias("data"))


@query
def tiles_without_features(spark, d):
    return cov.tiles_without_features(fx.tiles(spark, d), fx.features(spark, d), fx.REGION).select(*KEY)


@query
def clip_features_to_grid(spark, d):
    pieces = ft.clip_to_tiles(fx.tiles(spark, d), fx.features(spark, d), fx.REGION)
    return pieces.select("fid", *KEY)


@query
def clip_paths_to_grid(spark, d):
    """Length, in thousandths, of each line on each tile."""
    lines = ft.of_kind(fx.mixed_geometries(spark, d), "LineString", "MultiLineString")
    pieces = ft.clip_to_tiles(fx.tiles(spark, d), lines, fx.REGION)
    return pieces.select("fid", *KEY, F.expr(f"bigint(floor({geo.path_length('piece')} * 1000 + 0.5D))").alias("length_e3")).where(
        "length_e3 > 0")


@query
def clip_metadata_first(spark, d):
    """Features that meet the first region, clipped to the tiles."""
    return pipelines.clip_metadata(fx.tiles(spark, d), fx.features(spark, d), fx.regions(spark, d), True, fx.BIN, fx.REGION).select("fid", *KEY)


@query
def clip_metadata_all(spark, d):
    return pipelines.clip_metadata(fx.tiles(spark, d), fx.features(spark, d), fx.regions(spark, d), False, None, fx.REGION).select("fid", *KEY)


@query
def feature_feature_join(spark, d):
    f = fx.features(spark, d)
    return cov.features_intersect(f, f, fx.BIN, ordered=True)


@query
def compare_layouts(spark, d):
    merged = layout.layout_metadata(fx.cells(spark, d), fx.TILE)
    rebuilt = layout.layout_from_names(coded_tiles(spark, d), fx.TILE)
    return layout.compare_layouts(merged, rebuilt)


# --- aggregations ----------------------------------------------------------------------------

@query
def layout_metadata(spark, d):
    return layout.layout_metadata(fx.cells(spark, d), fx.TILE)


@query
def layout_from_names(spark, d):
    return layout.layout_from_names(coded_tiles(spark, d), fx.TILE)


@query
def features_per_tile(spark, d):
    pairs = cov.tile_features(fx.tiles(spark, d), fx.features(spark, d), fx.REGION)
    return pairs.groupBy(*KEY).agg(F.count("*").alias("n_features"))


@query
def inverted_index(spark, d):
    return postings(spark, d)


@query
def inverted_index_counts(spark, d):
    return index.posting_counts(index.text_words(fx.read(spark, d, "documents"), "doc_id", "text"))


@query
def tile_cut(spark, d):
    tiles = raster.assemble_tiles(fx.cells(spark, d), BANDS, fx.TILE)
    return raster.tile_digest(tiles, 1).withColumnsRenamed({"total": "sum_b1", "low": "min_b1", "high": "max_b1"})


@query
def mosaic(spark, d):
    return raster.mosaic(fx.cells(spark, d), BANDS, fx.ORIGIN_X, fx.ORIGIN_Y, fx.TILE)


@query
def feature_stats(spark, d):
    return ft.statistics(fx.features(spark, d))


# --- search ----------------------------------------------------------------------------------

@query
def keyword_and_search(spark, d):
    return search.search_all(postings(spark, d), [*KEYWORDS, "acctbal"])


@query
def keyword_and_search_lenient(spark, d):
    return search.search_all(postings(spark, d), [*KEYWORDS, "no_such_keyword"], mode="lenient")


@query
def keyword_and_search_setop(spark, d):
    return search.search_all_by_sets(postings(spark, d), [*KEYWORDS, "acctbal"])


def stored_bitmaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index of the given tables as bitmaps, stored and read back, and the bits of the datasets' curves."""
    folder = new_folder(spark, "bitmaps")
    tiles = coded_tiles(spark, d).select(*KEY, "sfc")
    tables.write_bitmaps(bitmaps.build_bitmaps(postings(spark, d).join(tiles, KEY)), folder)
    return spark.read.parquet(folder), layout.curve_sizes(tiles)


@query
def keyword_and_search_bitmap(spark, d):
    stored, sizes = stored_bitmaps(spark, d)
    return bitmaps.tiles_found(bitmaps.and_search(stored, [*KEYWORDS, "acctbal"]), sizes)


@query
def keyword_or_search_bitmap(spark, d):
    stored, sizes = stored_bitmaps(spark, d)
    return bitmaps.tiles_found(bitmaps.or_search(stored, [*KEYWORDS, "acctbal"]), sizes)


@query
def keyword_tile_counts(spark, d):
    return bitmaps.tile_counts(stored_bitmaps(spark, d)[0])


# --- order -----------------------------------------------------------------------------------

@query
def first_query_feature(spark, d):
    first = ft.first_feature(fx.features(spark, d).select("seg", "fid", "rings"), "seg")
    return first.selectExpr("seg", "fid", f"inline(array({geo.envelope('rings')}))")


@query
def tiles_in_curve_order(spark, d):
    ordered = layout.curve_order(coded_tiles(spark, d))
    return ordered.select(*KEY, "sfc", "pos").orderBy("dataset_uid", "sfc")


# --- scalar functions ------------------------------------------------------------------------

@query
def zorder_encode(spark, d):
    return fx.cells(spark, d).select(
        "dataset_uid", "px", "py", sfc.zorder_encode(F.col("px"), F.col("py")).alias("code"))


@query
def zorder_roundtrip(spark, d):
    line = fx.read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 7 % 2147483648).alias("col"),
        ((F.col("l_partkey") * 1009 + F.col("l_linenumber")) % 2147483648).alias("row_"))
    coded = line.withColumn("code", sfc.zorder_encode(F.col("col"), F.col("row_")))
    key = sfc.zorder_decode(F.col("code"))
    return coded.select("col", "row_", key["col"].alias("back_col"), key["row"].alias("back_row"))


@query
def hilbert_encode(spark, d):
    return coded_tiles(spark, d).select(*KEY, "sfc")


@query
def hilbert_roundtrip(spark, d):
    bits = F.lit(6)
    coded = fx.cells(spark, d).withColumn("code", sfc.hilbert_encode(F.col("px"), F.col("py"), bits))
    key = sfc.hilbert_decode(F.col("code"), bits)
    return coded.select("dataset_uid", "px", "py", "code", key["col"].alias("back_px"), key["row"].alias("back_py"))


@query
def tile_code_format(spark, d):
    key = F.col("o_orderkey")
    codes = fx.read(spark, d, "orders").select(
        key, F.when(key % 2 == 0, key + 68719476736).otherwise(key).alias("sfc"))
    coded = codes.withColumn("tile_code", sfc.tile_code(F.col("sfc")))
    return coded.withColumn("back", sfc.tile_code_value(F.col("tile_code")))


@query
def tile_snap(spark, d):
    x = F.col("o_totalprice")
    return fx.read(spark, d, "orders").select(
        "o_orderkey",
        scalars.floor_count(x).alias("floor_count"), scalars.floor_value(x).alias("floor_value"),
        scalars.ceiling_count(x).alias("ceiling_count"), scalars.ceiling_value(x).alias("ceiling_value"))


@query
def round_half_up(spark, d):
    x = (F.col("o_orderkey") - 100) / 8.0
    return fx.read(spark, d, "orders").select(
        "o_orderkey",
        scalars.round_half_up(x, 2).alias("r2"), scalars.round_half_up(x, 0).alias("r0"),
        scalars.nanos_to_seconds(F.col("o_orderkey") * 1234567).alias("seconds"),
        scalars.bytes_to_unit(F.col("o_orderkey") * 1000003, 2).alias("mib"))


@query
def date_label(spark, d):
    return fx.read(spark, d, "events").select("event_id", scalars.date_label(F.col("ts")).alias("label"))


@query
def json_keys(spark, d):
    events = index.json_keywords(fx.read(spark, d, "events"), "event_id", "props")
    attrs = fx.features(spark, d).select("fid", F.to_json("attrs").alias("js"))
    customers = index.json_keywords(attrs, "fid", "js")
    return events.select(F.lit("events").alias("src"), F.col("doc").alias("id"), "kw").union(
        customers.select(F.lit("customer"), "doc", "kw"))


# --- raster ----------------------------------------------------------------------------------

@query
def reproject_points(spark, d):
    pts = fx.read(spark, d, "orders").select(
        "o_orderkey",
        (fx.ORIGIN_X + 10.0 * (F.col("o_orderkey") % 256)).alias("x"),
        (fx.ORIGIN_Y - 10.0 * (F.col("o_orderkey") % 64)).alias("y"))
    geographic = projection.to_lonlat(pts, "x", "y", fx.EPSG, "lon", "lat")
    back = projection.from_lonlat(geographic, "lon", "lat", fx.EPSG, "x2", "y2")
    both = projection.from_lonlat(back, "lon", "lat", 3857, "mx", "my")

    def rounded(c, scale):
        return F.floor(c * scale + 0.5).cast("bigint")

    return both.select(
        "o_orderkey", rounded(F.col("lon"), 1e7).alias("lon_e7"), rounded(F.col("lat"), 1e7).alias("lat_e7"),
        rounded(F.col("x2"), 1000.0).alias("x_mm"), rounded(F.col("y2"), 1000.0).alias("y_mm"),
        rounded(F.col("mx"), 1000.0).alias("mx_mm"), rounded(F.col("my"), 1000.0).alias("my_mm"))


@query
def reproject_raster(spark, d):
    out = raster.reproject(fx.cells(spark, d), BANDS, fx.EPSG, 3857, 10.0, fx.TILE)
    return out.select("dataset_uid", "gx", "gy", *[F.floor(F.col(b) * 100 + 0.5).cast("bigint").alias(b + "_e2")
                                                  for b in BANDS])


@query
def resample_bilinear(spark, d):
    return raster.resample_bilinear(fx.cells(spark, d), BANDS, 0.25, 0.5)


@query
def resample_bilinear_tiles(spark, d):
    """The same kernel over stored tiles and their neighbours' borders; cells without a value are left out."""
    moved = halo.resample_bilinear_tiles(stored_layer(spark, d)[0], 0.25, 0.5, fx.TILE)
    return raster.tile_cells(moved, BANDS, fx.TILE).where("b1 IS NOT NULL OR b2 IS NOT NULL").select("dataset_uid", "px", "py", *BANDS)


@query
def mask_region(spark, d):
    spans = raster.mask_spans(fx.tiles(spark, d), fx.regions(spark, d), fx.TILE, fx.REGION)
    return raster.mask_cells(fx.cells(spark, d), spans).select("region_id", "dataset_uid", "px", "py", *BANDS)


@query
def mask_region_tiles(spark, d):
    tiles = raster.assemble_tiles(fx.cells(spark, d), BANDS, fx.TILE)
    spans = raster.mask_spans(fx.tiles(spark, d), fx.regions(spark, d), fx.TILE, fx.REGION)
    masked = raster.mask_tiles(tiles, spans, fx.TILE)
    band = F.element_at("bands", 2)
    present = F.filter(band, lambda v: v.isNotNull())
    return masked.select(
        "region_id", *KEY, F.size(present).cast("bigint").alias("n_kept"),
        F.aggregate(present, F.lit(0.0), lambda a, v: a + v).alias("sum_b2"))


@query
def crop_to_region(spark, d):
    out = raster.crop_cells(fx.cells(spark, d), fx.tiles(spark, d), fx.regions(spark, d), BANDS, fx.TILE, fx.REGION)
    return out.select("region_id", "dataset_uid", "px", "py", "in_region", *BANDS)


# --- composite jobs --------------------------------------------------------------------------

@query
def pipeline_tile_raster(spark, d):
    tiles = pipelines.tile_raster(fx.cells(spark, d), BANDS, tile_size=fx.TILE)
    sums = [F.aggregate(F.filter(F.element_at("bands", i + 1), lambda v: v.isNotNull()),
                        F.lit(0.0), lambda a, v: a + v).alias("sum_" + b) for i, b in enumerate(BANDS)]
    return tiles.select(*KEY, *layout.EXTENT, "sfc", "file_name", *sums)


@query
def pipeline_query_region(spark, d):
    out = pipelines.query_region(fx.cells(spark, d), fx.tiles(spark, d), fx.regions(spark, d), fx.TILE, fx.REGION)
    return out.select("dataset_uid", "px", "py", *BANDS)


@query
def search_then_query(spark, d):
    out = pipelines.search_then_query(
        fx.cells(spark, d), fx.tiles(spark, d), fx.regions(spark, d), postings(spark, d), KEYWORDS,
        all_features=True, tile_size=fx.TILE, region_size=fx.REGION)
    return out.select("region_id", "dataset_uid", "px", "py", *BANDS)


@query
def query_region_tiles(spark, d):
    """The first region, from stored tiles."""
    tiles, layouts = stored_layer(spark, d)
    return tile_sums(pipelines.query_region_tiles(tiles, fx.regions(spark, d), fx.TILE, fx.REGION, layouts=layouts))


@query
def search_then_query_tiles(spark, d):
    tiles, layouts = stored_layer(spark, d)
    out = pipelines.search_then_query_tiles(tiles, fx.regions(spark, d), postings(spark, d), KEYWORDS, all_features=True,
                                            tile_size=fx.TILE, region_size=fx.REGION, layouts=layouts)
    return tile_sums(out, "region_id")


@query
def search_then_query_first(spark, d):
    out = pipelines.search_then_query(
        fx.cells(spark, d), fx.tiles(spark, d), fx.regions(spark, d), postings(spark, d), ["UID"],
        tile_size=fx.TILE, region_size=fx.REGION)
    return out.select("region_id", "dataset_uid", "px", "py", *BANDS)


@query
def pipeline_simple(spark, d):
    """Features that touch the tiles under the first region."""
    found = pipelines.simple_query(
        fx.cells(spark, d), fx.regions(spark, d), fx.features(spark, d), fx.TILE, fx.REGION)
    return found.features.select("fid", F.to_json("attrs").alias("data"))


@query
def pipeline_simple_cells(spark, d):
    """Cells of the first region, stitched onto the global grid."""
    found = pipelines.simple_query(
        fx.cells(spark, d), fx.regions(spark, d), fx.features(spark, d), fx.TILE, fx.REGION)
    return raster.mosaic(found.cells, BANDS, fx.ORIGIN_X, fx.ORIGIN_Y, fx.TILE)


# --- many scenes, one layer ------------------------------------------------------------------

@query
def layer_from_scenes(spark, d):
    """Overlapping scenes with origins of their own as the coded tiles of one layer."""
    tiles = scenes.layer_from_scenes(fx.scenes(spark, d), BANDS, "layer", tile_size=fx.TILE)
    return tile_sums(tiles, *layout.EXTENT, "sfc", "file_name")


@query
def mosaic_stored_tiles(spark, d):
    """Stored tiles of overlapping datasets, merged as arrays where they meet."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/layer-{uuid.uuid4().hex}"
    tables.write_tiles(pipelines.tile_raster(fx.scenes(spark, d), BANDS, tile_size=fx.TILE), folder)
    return tile_sums(scenes.mosaic_tiles(tables.read_tiles(spark, folder), len(BANDS), "layer", fx.TILE), *layout.EXTENT)


@query
def pipeline_tile_raster_reprojected(spark, d):
    """The tiling job with a projection of its own; values in hundredths, summed exactly."""
    tiles = pipelines.tile_raster(fx.cells(spark, d), BANDS, tile_size=fx.TILE, source_epsg=fx.EPSG, target_epsg=3857, cell_size=10.0)
    present = [F.filter(F.element_at("bands", i + 1), lambda v: v.isNotNull()) for i in range(len(BANDS))]
    hundredths = [F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x * 100 + 0.5)).alias(f"sum_{b}_e2")
                  for b, v in zip(BANDS, present)]
    return tiles.select(*KEY, *layout.EXTENT, "sfc", "file_name", F.size(present[-1]).cast("bigint").alias("n_kept"), *hundredths)


# --- cell types ------------------------------------------------------------------------------

def typed_layer(spark: SparkSession, d: str, cell_type: str, epsg: int) -> DataFrame:
    """The tiles of the given tables with a cell type and projection, stored and read back."""
    folder = new_folder(spark, "typed")
    tiles = pipelines.tile_raster(fx.cells(spark, d), BANDS, tile_size=fx.TILE)
    tables.write_tiles(typed.with_cell_type(tiles, cell_type, epsg, fx.TILE), folder)
    return tables.read_tiles(spark, folder)


@query
def typed_tiles(spark, d):
    return tile_sums(typed.as_doubles(typed_layer(spark, d, "uint16", fx.EPSG)), "cell_type", "epsg")


@query
def layer_metadata_typed(spark, d):
    return typed.layer_metadata(typed_layer(spark, d, "uint16", fx.EPSG))


@query
def compare_typed_layers(spark, d):
    """All tiles as uint16 against those right of the first column, as int32."""
    left, right = (typed_layer(spark, d, t, fx.EPSG) for t in ("uint16", "int32"))
    return typed.compare_layers(typed.layer_metadata(left), typed.layer_metadata(right.where("col > 0")))
