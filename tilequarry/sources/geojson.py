"""GeoJSON features, one per line or as FeatureCollection files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.functions.geometry import RINGS_TYPE

FEATURE = "geometry struct<type:string, coordinates:string>, properties map<string,string>"

# How deep the coordinates of each kind are nested, and how they become rings.
_PATHS = {
    "Point": ("array<double>", "array(array(c))"),
    "MultiPoint": ("array<array<double>>", "transform(c, p -> array(p))"),
    "LineString": ("array<array<double>>", "array(c)"),
    "MultiLineString": ("array<array<array<double>>>", "c"),
    "Polygon": ("array<array<array<double>>>", "c"),
    "MultiPolygon": ("array<array<array<array<double>>>>", "flatten(c)"),
}


def _rings() -> str:
    """Rings of a geometry column; null for a kind that is not known."""
    cases = " ".join(
        f"WHEN '{kind}' THEN transform(array(from_json(geometry.coordinates, '{sql_type}')), c -> {shape})[0]"
        for kind, (sql_type, shape) in _PATHS.items())
    points = "transform(paths, path -> transform(path, p -> named_struct('x', p[0], 'y', p[1])))"
    return f"transform(array(CASE geometry.type {cases} END), paths -> {points})[0]"


def parse_features(raw: DataFrame) -> DataFrame:
    """fid, geom_type, rings, attrs from rows of (fid, geometry, properties).

    Rows whose geometry kind is unknown or missing keep a null ``rings``.
    """
    return raw.selectExpr(
        "fid", "geometry.type AS geom_type", f"cast({_rings()} AS {RINGS_TYPE}) AS rings",
        "map_filter(coalesce(properties, map()), (k, v) -> v IS NOT NULL) AS attrs")


def _numbered(raw: DataFrame, id_property: str | None) -> DataFrame:
    fid = (F.try_element_at("properties", F.lit(id_property)).cast("bigint") if id_property
           else F.xxhash64(F.to_json("geometry"), F.to_json(F.map_entries("properties"))))
    return raw.withColumn("fid", fid)


def read_geojson_lines(spark: SparkSession, path: str, id_property: str | None = None) -> DataFrame:
    """Newline-delimited features; large files are split between tasks.

    ``fid`` is the named property, or a hash of the feature.
    """
    return parse_features(_numbered(spark.read.schema(FEATURE).json(path), id_property))


def read_geojson(spark: SparkSession, path: str, id_property: str | None = None) -> DataFrame:
    """FeatureCollection files.  Such a file is one JSON value and is read by one task, so
    prefer the line form for large inputs."""
    collections = spark.read.schema(f"features array<struct<{FEATURE.replace(' struct<', ':struct<', 1).replace('properties map', 'properties:map')}>>").json(
        path, multiLine=True)
    return parse_features(_numbered(collections.selectExpr("inline(features)"), id_property))
