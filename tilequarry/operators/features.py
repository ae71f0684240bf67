"""Vector feature operators.

``features`` rows: ``fid BIGINT, geom_type STRING, rings, attrs MAP<STRING, STRING>``
and optionally ``env STRUCT<xmin, ymin, xmax, ymax>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.functions import geometry as geo
from tilequarry.operators import coverage as cov

# The geometry kinds a feature may have.
GEOMETRY_KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


def of_kind(features: DataFrame, *kinds: str) -> DataFrame:
    """Features of the given geometry kinds; all others are left out."""
    for kind in kinds:
        if kind not in GEOMETRY_KINDS:
            raise ValueError(f"unknown geometry kind {kind!r}; use one of {GEOMETRY_KINDS}")
    return features.where(F.col("geom_type").isin(*kinds))


def attribute(name: str, sql_type: str = "string") -> Column:
    """One attribute as ``sql_type``; null where it is missing or does not convert."""
    return F.try_element_at("attrs", F.lit(name)).try_cast(sql_type)


def single_attribute(features: DataFrame, kinds: tuple[str, ...], name: str, sql_type: str) -> DataFrame:
    """Features of the given kinds with one typed attribute in place of the map."""
    return of_kind(features, *kinds).select("fid", "geom_type", "rings", attribute(name, sql_type).alias("value"))


def envelopes(features: DataFrame) -> DataFrame:
    """fid, xmin, ymin, xmax, ymax."""
    return features.selectExpr("fid", *[f"{geo.envelope_side('rings', s)} AS {s}" for s in geo.EXTENT])


def first_feature(features: DataFrame, query_id: str) -> DataFrame:
    """The feature with the lowest fid of each query; an aggregate, so no query is sorted."""
    kept = [c for c in features.columns if c != query_id]
    return features.groupBy(query_id).agg(
        F.min_by(F.struct(*kept), F.col("fid")).alias("f")).select(query_id, "f.*")


def statistics(features: DataFrame) -> DataFrame:
    """Feature, ring and vertex totals in one row."""
    return features.agg(
        F.count("*").alias("n_features"),
        F.coalesce(F.sum(F.size("rings")), F.lit(0)).cast("bigint").alias("n_rings"),
        F.coalesce(F.sum(F.expr(geo.vertex_count("rings"))), F.lit(0)).alias("n_vertices"),
    )


def flatten_attributes(features: DataFrame, columns: dict[str, str], epsg: int) -> DataFrame:
    """Attributes as typed columns, with the projection's code: a plain feature table.

    Values that do not convert become null and are counted per row in
    ``n_bad_values``; no feature is dropped.
    """
    bad = F.lit(0)
    for name, sql_type in columns.items():
        text = F.try_element_at("attrs", F.lit(name))
        bad = bad + (text.isNotNull() & text.try_cast(sql_type).isNull()).cast("int")
    return features.select(
        "fid", "geom_type", "rings", F.lit(f"EPSG:{epsg}").alias("srs"),
        *[attribute(n, t).alias(n) for n, t in columns.items()], bad.alias("n_bad_values"),
    )


def _position(p: Column) -> Column:
    return F.array(p["x"], p["y"])


def with_parts(features: DataFrame) -> DataFrame:
    """Add ``parts``: a multipolygon's rings nested by containment, each part a shell and its holes; null for other kinds."""
    columns = [c for c in features.columns if c != "parts"]
    several = "geom_type = 'MultiPolygon' AND size(rings) > 1"
    around = features.selectExpr(*columns, f"if({several}, {geo.rings_around('rings')}, NULL) AS around_")
    found = around.selectExpr(*columns, f"{geo.hole_shells('around_')} AS shells_")
    return found.selectExpr(*columns, f"""CASE WHEN {several} THEN {geo.nested_parts('rings', 'shells_')}
        WHEN geom_type = 'MultiPolygon' THEN transform(rings, r -> array(r)) END AS parts""")


def geojson_geometry(rings: Column, kind: Column, parts: Column) -> Column:
    """GeoJSON geometry text; ``parts`` holds a multipolygon's nested rings."""
    def path(r: Column) -> Column:
        return F.transform(r, _position)

    paths = F.transform(rings, path)

    def geometry(coordinates: Column) -> Column:
        return F.to_json(F.struct(kind.alias("type"), coordinates.alias("coordinates")))

    return (
        F.when(kind == "Point", geometry(F.element_at(F.flatten(paths), 1)))
        .when(kind == "MultiPoint", geometry(F.flatten(paths)))
        .when(kind == "LineString", geometry(F.element_at(paths, 1)))
        .when(kind == "MultiPolygon", geometry(F.transform(parts, lambda p: F.transform(p, path))))
        .otherwise(geometry(paths))
    )


def to_geojson(features: DataFrame, name_attr: str) -> DataFrame:
    """(name, geometry, data): the two texts written per feature, and what names them."""
    return with_parts(features).select(
        "fid", F.try_element_at("attrs", F.lit(name_attr)).alias("name"),
        geojson_geometry(F.col("rings"), F.col("geom_type"), F.col("parts")).alias("geometry"),
        F.to_json("attrs").alias("data"),
    )


def to_geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature a line, as ``geojson.read_geojson_lines`` reads them."""
    text = with_parts(features).select(
        geojson_geometry(F.col("rings"), F.col("geom_type"), F.col("parts")).alias("geometry"), F.to_json("attrs").alias("data"))
    return text.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry", F.lit("null")),
                                F.lit(',"properties":'), F.coalesce("data", F.lit("{}")), F.lit("}")).alias("line"))


def clip_to_tiles(tiles: DataFrame, features: DataFrame, region_size: float | None = cov.REGION_SIZE) -> DataFrame:
    """One clipped piece per tile that a feature intersects.

    A feature is first cut into bands, one per tile row, and each band into tiles,
    so the work is vertices times rows rather than vertices times tiles.  Tiles
    wholly inside get their rectangle without any cutting.
    """
    features = cov.once(features)
    pairs = cov.tile_features(tiles, features, region_size)
    rect = geo.box_ring("xmin", "ymin", "xmax", "ymax")
    out = ["fid", "dataset_uid", "col", "row_", "is_inside"]
    whole = pairs.where("is_inside").selectExpr(*out, f"array({rect}) AS piece")
    edge = pairs.where("NOT is_inside")
    bands = (
        edge.select("fid", "ymin", "ymax").distinct().join(features.select("fid", "rings"), "fid")
        .selectExpr("fid", "ymin", "ymax", f"{geo.clip_to_band('rings', 'y', 'ymin', 'ymax')} AS band")
    )
    cut = edge.join(bands, ["fid", "ymin", "ymax"]).selectExpr(
        *out, f"{geo.clip_to_band('band', 'x', 'xmin', 'xmax')} AS piece")
    return whole.union(cut)
