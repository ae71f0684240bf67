"""Open paths, points and polygons cut at tile edges."""

import math
import random

import pytest
import shapes
from pyspark.sql import Row
from pyspark.sql import functions as F

from tilequarry.functions import geometry as geo
from tilequarry.operators import features as ft
from tilequarry.plans import pipelines


def clipped(spark, rings, axis="x", low=0.0, high=4.0):
    frame = spark.createDataFrame([([[Row(x=float(x), y=float(y)) for x, y in r] for r in rings],)], f"rings {shapes.RINGS}")
    out = frame.selectExpr(f"{geo.clip_to_band('rings', axis, repr(low), repr(high))} AS r").first().r
    return [[(p.x, p.y) for p in ring] for ring in out]


def test_a_path_that_comes_back_becomes_several_and_stays_open(spark):
    assert clipped(spark, [[(-2, 0), (2, 0), (6, 2), (6, 4), (2, 4), (2, 6)]]) == [
        [(0.0, 0.0), (2.0, 0.0), (4.0, 1.0)], [(4.0, 4.0), (2.0, 4.0), (2.0, 6.0)]]
    assert clipped(spark, [[(1, 0), (2, 0), (2, 0), (3, 1)]]) == [[(1.0, 0.0), (2.0, 0.0), (3.0, 1.0)]]
    # Along the edge counts, touching it does not; what is outside goes.
    assert clipped(spark, [[(4, 0), (4, 3)], [(6, 0), (4, 1), (6, 2)], [(5, 0), (9, 9)]]) == [[(4.0, 0.0), (4.0, 3.0)]]
    assert clipped(spark, [[(0, -3), (1, 5)]], "y", -1.0, 1.0) == [[(0.25, -1.0), (0.5, 1.0)]]


def test_points_rings_and_paths_together(spark):
    box = [(2, 0), (6, 0), (6, 2), (2, 2), (2, 0)]
    got = clipped(spark, [[(4, 9)], [(5, 9)], box, [(0, 0), (8, 0)], []])
    assert [(4.0, 9.0)] in got and [(0.0, 0.0), (4.0, 0.0)] in got and len(got) == 3
    ring = next(r for r in got if len(r) > 2)
    assert ring[0] == ring[-1] and set(ring) == {(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0)}
    assert clipped(spark, []) == []


def test_lengths_on_tiles_add_up(spark):
    rng = random.Random(8)
    paths = [(i, [[(rng.uniform(0.1, 31.9), -rng.uniform(0.1, 31.9)) for _ in range(rng.randint(2, 12))] for _ in range(2)]) for i in range(25)]
    tiles = spark.createDataFrame(shapes.tile_rows("d1", 0, 0, 8, 8, 4, 4), shapes.TILE_SCHEMA)
    features = shapes.features_frame(spark, paths)
    pieces = ft.clip_to_tiles(tiles, features, 16.0)
    got = {r.fid: r.n for r in pieces.groupBy("fid").agg(F.sum(F.expr(geo.path_length("piece"))).alias("n")).collect()}
    for fid, rings in paths:
        assert math.isclose(got[fid], sum(math.dist(p, q) for p, q in shapes.edges(rings)), rel_tol=1e-9)
    over = pieces.join(tiles, ["dataset_uid", "col", "row_"]).where(
        "exists(flatten(piece), p -> p.x < xmin - 1e-9 OR p.x > xmax + 1e-9 OR p.y < ymin - 1e-9 OR p.y > ymax + 1e-9)")
    assert over.count() == 0


def test_clip_metadata_filters_first(spark):
    tiles = spark.createDataFrame(shapes.tile_rows("d1", 0, 0, 8, 8, 4, 4), shapes.TILE_SCHEMA)
    features = shapes.features_frame(spark, shapes.random_polygons(3, 40, 32, 6))
    region = shapes.features_frame(spark, [(0, [[(0, 0), (10, 0), (10, -10), (0, -10), (0, 0)]])])
    every = {(r.fid, r.col, r.row_) for r in pipelines.clip_metadata(tiles, features, region, False, region_size=16.0).collect()}
    first = {(r.fid, r.col, r.row_) for r in pipelines.clip_metadata(tiles, features, region, True, 8.0, 16.0).collect()}
    met = {fid for fid, rings in shapes.random_polygons(3, 40, 32, 6) if shapes.meets_box(rings, (0.0, -10.0, 10.0, 0.0))}
    assert first == {k for k in every if k[0] in met} and first and first != every
    with pytest.raises(ValueError):
        pipelines.clip_metadata(tiles, features, region, True)
