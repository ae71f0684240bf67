"""Raster, vector and tag tables derived from the given tables.

All are plain projections of their source, so they scale with it and cost no
shuffle.  Coordinates are whole numbers, hence exact in double arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilequarry.functions import geometry as geo
from tilequarry.operators import coverage, layout

# Fixed values of the derived data.
TILE = 8            # cells per tile edge
CELL = 10.0         # metres
SIDE = 64           # cells per dataset edge
ORIGIN_X, ORIGIN_Y = 300000.0, 1500000.0
EPSG = 32651
REGION = 2560.0     # coarse squares for pairing features with grids
BIN = 80.0          # bins of the feature-feature join


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.  Its schema is looked up once, as that costs a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 x 64 two-band raster per 4096 orders."""
    keyed = read(spark, sf_dir, "orders").selectExpr("*", "floor(o_orderkey / 4096) AS k")
    base = keyed.selectExpr(
        "if(length(k) >= 8, string(k), lpad(string(k), 8, '0')) AS dataset_uid",
        f"int(o_orderkey % {SIDE}) AS px", f"int(floor((o_orderkey % 4096) / {SIDE})) AS py",
        f"{ORIGIN_X}D + {CELL}D * {SIDE} * (k % 4) AS x0", f"{ORIGIN_Y}D - {CELL}D * {SIDE} * floor(k / 4) AS y0",
        f"{CELL}D AS cell_w", f"{CELL}D AS cell_h",
        "if(o_orderstatus = 'P', NULL, double(floor(o_totalprice) % 4096)) AS b1",
        "double(o_custkey % 256) AS b2")
    return layout.cut_to_grid(layout.cell_center(base), TILE)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rasters laid closer, so that neighbours overlap, each with an origin of its own."""
    k = F.col("dataset_uid").cast("bigint")
    step = SIDE - 12
    moved = cells(spark, sf_dir).withColumns({
        "x0": ORIGIN_X + CELL * (step * (k % 4) + k % 3), "y0": ORIGIN_Y - CELL * (step * F.floor(k / 4) + k % 2)})
    return layout.cut_to_grid(layout.cell_center(moved), TILE)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.footprints(cells(spark, sf_dir), TILE)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multipolygon per customer: boxes, triangles, diamonds, boxes with a hole, pairs of boxes."""
    base = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS fid", "c_nationkey", "c_acctbal", "c_mktsegment AS seg",
        f"{ORIGIN_X}D + {CELL}D * ((c_custkey * 97) % 509) AS x",
        f"{ORIGIN_Y}D - {CELL}D * ((c_custkey * 61) % 257) AS y",
        f"{CELL}D * (1 + c_custkey % 4) AS r",
        f"double(floor({CELL}D * (1 + c_custkey % 4) * 0.4D)) AS hh",
        "c_custkey % 5 AS shp")
    box = geo.box_ring("x - r", "y - r", "x + r", "y + r")
    hole = geo.box_ring("x - hh", "y - hh", "x + hh", "y + hh")
    moved = geo.box_ring("x + 120 - r", "y - r", "x + 120 + r", "y + r")
    triangle = geo.ring(("x - r", "y - r"), ("x + r", "y - r"), ("x", "y + r"))
    diamond = geo.ring(("x", "y - r"), ("x + r", "y"), ("x", "y + r"), ("x - r", "y"))
    return coverage.known_unique(base.selectExpr(
        "fid", "'MultiPolygon' AS geom_type",
        f"""CASE shp WHEN 0 THEN array({box}) WHEN 1 THEN array({triangle}) WHEN 2 THEN array({diamond})
            WHEN 3 THEN array({box}, {hole}) ELSE array({box}, {moved}) END AS rings""",
        """map_from_entries(filter(array(
             struct('Block_Name' AS k, concat('B', fid % 50) AS v),
             struct('UID' AS k, string(fid) AS v),
             struct('acctbal' AS k, if(fid % 7 = 0, string(c_acctbal), NULL) AS v),
             struct('nation' AS k, if(fid % 3 = 0, string(c_nationkey), NULL) AS v),
             struct(concat('seg_', lower(seg)) AS k, '1' AS v)), e -> e.v IS NOT NULL)) AS attrs""",
        "seg", "shp"))


def mixed_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features, each as one of the six geometry kinds, by ``fid % 6``."""
    return features(spark, sf_dir).selectExpr(
        "fid", "attrs",
        """CASE fid % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon'
           WHEN 3 THEN 'MultiPoint' WHEN 4 THEN 'MultiLineString' ELSE 'MultiPolygon' END AS geom_type""",
        """CASE fid % 6
           WHEN 0 THEN array(slice(rings[0], 1, 1))
           WHEN 1 THEN array(slice(rings[0], 1, size(rings[0]) - 1))
           WHEN 2 THEN array(rings[0])
           WHEN 3 THEN transform(rings[0], p -> array(p))
           WHEN 4 THEN transform(rings, r -> slice(r, 1, size(r) - 1))
           ELSE rings END AS rings""")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An L-shaped query polygon per region."""
    x, y = f"{ORIGIN_X + 100}D + 450 * r_regionkey", f"{ORIGIN_Y - 50}D"
    offsets = ((0, 0), (400, 0), (400, -200), (200, -200), (200, -400), (0, -400))
    shape = geo.ring(*[(f"{x} + {dx}", f"{y} + {dy}") for dx, dy in offsets])
    return coverage.known_unique(read(spark, sf_dir, "region").selectExpr("bigint(r_regionkey) AS fid", f"array({shape}) AS rings"))
