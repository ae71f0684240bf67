"""The spatial joins against brute force: several grids, odd shapes, hot tiles."""

import random
import re

import pytest
import shapes
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilequarry.functions import geometry as geo
from tilequarry.operators import coverage as cov
from tilequarry.operators import documents, layout
from tilequarry.operators import features as ft


def two_grids(spark):
    """Two datasets on one grid, one that overlaps them on another, and a coarser one."""
    rows = (shapes.tile_rows("a", 0, 0, 8, 8, 6, 6) + shapes.tile_rows("b", 48, 0, 8, 8, 4, 6)
            + shapes.tile_rows("c", 3, -5, 8, 8, 5, 5) + shapes.tile_rows("d", -10, 10, 20, 16, 4, 4))
    return rows, spark.createDataFrame(rows, shapes.TILE_SCHEMA)


def brute(rows, polygons):
    return {(r[0], r[1], r[2], fid) for r in rows for fid, rings in polygons if shapes.meets_box(rings, r[3:7])}


def joined(tiles, features, region_size=32.0):
    got = cov.tile_features(tiles, features, region_size).select("dataset_uid", "col", "row_", "fid").collect()
    assert len(got) == len(set(map(tuple, got))), "a pair came twice"
    return set(map(tuple, got))


def test_matches_brute_force_on_several_grids(spark):
    rows, tiles = two_grids(spark)
    polygons = shapes.random_polygons(7, 60, 70, 30, (-10.0, 10.0))
    assert joined(tiles, shapes.features_frame(spark, polygons)) == brute(rows, polygons)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), radius=st.sampled_from([2, 9, 60]), region=st.sampled_from([5.0, 32.0, 1e5]))
def test_matches_brute_force_for_any_size(spark, seed, radius, region):
    rows, tiles = two_grids(spark)
    polygons = shapes.random_polygons(seed, 25, 60, radius)
    assert joined(tiles, shapes.features_frame(spark, polygons), region) == brute(rows, polygons)


def test_touching_an_edge_or_a_corner_counts(spark):
    rows = shapes.tile_rows("a", 0, 0, 8, 8, 3, 3)
    tiles = spark.createDataFrame(rows, shapes.TILE_SCHEMA)
    box = [[(8.0, -8.0), (10.0, -8.0), (10.0, -16.0), (8.0, -16.0), (8.0, -8.0)]]
    got = joined(tiles, shapes.features_frame(spark, [(1, box)]))
    assert got == {("a", c, r, 1) for c in (0, 1) for r in (0, 1, 2)}


def test_inside_tiles_meet_no_edge_and_holes_stay_empty(spark):
    rows = shapes.tile_rows("a", 0, 0, 1, 1, 30, 30)
    tiles = spark.createDataFrame(rows, shapes.TILE_SCHEMA)

    def box(low, high):
        return [(low, -low), (high, -low), (high, -high), (low, -high), (low, -low)]

    polygons = [(1, [box(2.5, 27.5), box(10.5, 20.5)])]
    got = {(r.col, r.row_): r.is_inside for r in cov.tile_features(
        tiles, shapes.features_frame(spark, polygons), 10.0).collect()}
    assert (15, 15) not in got and got[(5, 5)] is True and got[(2, 2)] is False
    rings = polygons[0][1]
    for _, c, r, *rest in rows:
        touched = any(shapes.edge_meets_box(p, q, rest[:4]) for p, q in shapes.edges(rings))
        assert got.get((c, r)) == (False if touched else True if shapes.meets_box(rings, rest[:4]) else None)


def test_outer_semi_and_anti_joins_agree(spark):
    rows, tiles = two_grids(spark)
    polygons = shapes.random_polygons(3, 20, 60, 8)
    features = shapes.features_frame(spark, polygons)
    pairs = brute(rows, polygons)
    hit = {p[:3] for p in pairs}
    outer = cov.tiles_with_features(tiles, features, 32.0).select("dataset_uid", "col", "row_", "fid").collect()
    assert {tuple(r) for r in outer if r.fid is not None} == pairs
    assert {tuple(r)[:3] for r in outer} == {r[:3] for r in rows}
    empty = {tuple(r) for r in cov.tiles_without_features(tiles, features, 32.0).select(
        "dataset_uid", "col", "row_").collect()}
    assert empty == {r[:3] for r in rows} - hit
    assert {r.fid for r in cov.features_on_tiles(tiles, features, 32.0).collect()} == {p[3] for p in pairs}


def test_tiles_in_extents_is_half_open(spark):
    rows, tiles = two_grids(spark)
    boxes = [(1, 8.0, -16.0, 16.0, -8.0), (2, -3.25, -7.5, 11.0, 4.0), (3, 500.0, 0.0, 600.0, 10.0)]
    extents = spark.createDataFrame(boxes, "query_id bigint, xmin double, ymin double, xmax double, ymax double")
    want = {(q, *r[:3]) for q, a, b, c, d in boxes for r in rows if r[3] < c and r[5] > a and r[4] < d and r[6] > b}
    got = cov.tiles_in_extents(tiles, extents, 16.0).select("query_id", "dataset_uid", "col", "row_").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    one = cov.tiles_in_extent(tiles, *boxes[0][1:]).select("dataset_uid", "col", "row_").collect()
    assert {(1, *r) for r in map(tuple, one)} == {w for w in want if w[0] == 1}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), bin_size=st.sampled_from([3.0, 16.0, 200.0]))
def test_feature_pairs_match_brute_force(spark, seed, bin_size):
    left = shapes.random_polygons(seed, 20, 50, 12)
    right = shapes.random_polygons(seed + 1, 15, 50, 25)
    got = cov.features_intersect(
        shapes.features_frame(spark, left), shapes.features_frame(spark, right), bin_size).collect()
    want = {(a, b) for a, ra in left for b, rb in right if shapes.polygons_meet(ra, rb)}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_crowded_bins_are_cut_without_losing_a_pair(spark):
    left = shapes.random_polygons(31, 60, 40, 6)
    right = shapes.random_polygons(32, 60, 40, 6)
    frames = shapes.features_frame(spark, left), shapes.features_frame(spark, right)
    want = {(a, b) for a, ra in left for b, rb in right if shapes.polygons_meet(ra, rb)}
    got = cov.features_intersect(*frames, 64.0, pairs_per_bin=1).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_one_tile_under_a_third_of_all_features(spark):
    rows, tiles = two_grids(spark)
    hot = [(fid, [[(1.0, -1.0), (2.0, -1.0), (2.0, -2.0), (1.0, -1.0)]]) for fid in range(1000, 1400)]
    polygons = shapes.random_polygons(5, 40, 60, 10) + hot
    assert joined(tiles, shapes.features_frame(spark, polygons)) == brute(rows, polygons)


def test_clipped_pieces_add_up(spark):
    rows = shapes.tile_rows("a", 0, 0, 8, 8, 10, 10)
    tiles = spark.createDataFrame(rows, shapes.TILE_SCHEMA)
    polygons = [p for p in shapes.random_polygons(11, 30, 60, 9, (10.0, -10.0)) if len(p[1]) == 1]
    features = shapes.features_frame(spark, polygons)
    pieces = ft.clip_to_tiles(tiles, features, 40.0)
    area = f"aggregate(transform(piece, r -> {geo.ring_area('r')}), 0D, (a, v) -> a + v)"
    got = {r.fid: r.area for r in pieces.groupBy("fid").agg(F.expr(f"sum({area}) AS area")).collect()}
    for fid, rings in polygons:
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        if min(xs) < 0 or max(xs) > 80 or max(ys) > 0 or min(ys) < -80:
            continue
        want = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in shapes.edges(rings))) / 2
        assert abs(got[fid] - want) < 1e-6


def test_repeated_features_lines_and_points(spark):
    box = [[(0.5, -0.5), (5.5, -0.5), (5.5, -5.5), (0.5, -5.5), (0.5, -0.5)]]
    line, point = [[(0.5, -0.5), (3.5, -0.5)]], [[(2.5, -2.5)]]
    tiles = spark.createDataFrame(shapes.tile_rows("t", 0, 0, 1, 1, 6, 6), shapes.TILE_SCHEMA)
    features = shapes.features_frame(spark, [(1, box), (1, box), (2, line), (3, point)])
    found = {}
    for r in cov.tile_features(tiles, features, 10.0).collect():
        found.setdefault(r.fid, set()).add((r.col, r.row_))
    assert len(found[1]) == 36
    assert found[2] == {(c, 0) for c in range(4)} and found[3] == {(2, 2)}
    with pytest.raises(Exception, match="one geometry"):
        cov.tile_features(tiles, shapes.features_frame(spark, [(1, box), (1, line)]), 10.0).collect()


def test_repeated_features_are_one_in_every_operator(spark):
    box = [[(0.5, -0.5), (5.5, -0.5), (5.5, -5.5), (0.5, -5.5), (0.5, -0.5)]]
    within = [[(1.25, -1.25), (2.25, -1.25), (2.25, -2.25), (1.25, -1.25)]]
    tiles = layout.with_tile_code(spark.createDataFrame(shapes.tile_rows("t", 0, 0, 2, 2, 3, 4), shapes.TILE_SCHEMA))
    twice = shapes.features_frame(spark, [(1, box), (1, box)], UID=str)
    docs = documents.tile_documents(tiles, twice)
    assert docs.agg(F.sum("n_features")).first()[0] == sum(r.doc.count("UID") for r in docs.collect()) == 9
    assert cov.features_on_tiles(tiles, twice).count() == 1
    assert ft.clip_to_tiles(tiles, twice).count() == 9
    inner = shapes.features_frame(spark, [(7, within)])
    assert [tuple(r) for r in cov.features_intersect(inner, twice, 4.0).collect()] == [(7, 1)]
    assert [tuple(r) for r in cov.features_intersect(inner, twice, 4.0, direct_pairs=0).collect()] == [(7, 1)]
    with pytest.raises(Exception, match="one geometry"):
        cov.features_on_tiles(tiles, shapes.features_frame(spark, [(1, box), (1, within)])).collect()


def test_ids_are_checked_once(spark):
    features = shapes.features_frame(spark, shapes.random_polygons(1, 5, 20, 4))
    checked = cov.once(features)
    assert cov.once(checked) is checked and "Aggregate" not in checked.select("fid", "rings").where("fid > 1")._jdf.queryExecution().analyzed().toString().split("Filter")[0]
    assert cov.once(checked.where("fid > 1").select("fid", "rings")).columns == ["fid", "rings"]


@pytest.mark.parametrize("unit", [1.0, 1e-4, 1e5])
def test_squares_follow_the_size_of_what_they_hold(spark, unit):
    """From degrees to metres: no square holds more than its share, and no pair is lost between levels."""
    polygons = shapes.random_polygons(4, 120, 400, 4) + [(900, [[(0.0, 0.0), (400.0, 0.0), (400.0, -400.0), (0.0, 0.0)]])]
    scaled = [(f, [[(x * unit, y * unit) for x, y in r] for r in rings]) for f, rings in polygons]
    features = shapes.features_frame(spark, scaled)
    sides = features.select("fid", "rings").transform(lambda d: cov._with_sides(d, "a_")).select("fid", *["a_" + s for s in geo.EXTENT])
    right = sides.select(*[F.col(c).alias(c.replace("a_", "b_")).alias(c.replace("a_", "b_") if c != "fid" else "other") for c in sides.columns])
    got = {(r.fid, r.other) for r in cov.envelope_pairs(sides, right).select("fid", "other").collect()}
    rows = {r.fid: r for r in sides.collect()}
    want = {(a, b) for a, x in rows.items() for b, y in rows.items()
            if x.a_xmin <= y.a_xmax and x.a_xmax >= y.a_xmin and x.a_ymin <= y.a_ymax and x.a_ymax >= y.a_ymin}
    assert got == want
    own = sides.withColumn("level", cov._level("a_")).groupBy(
        "level", F.expr("floor(a_xmin / pow(4D, level))"), F.expr("floor(a_ymin / pow(4D, level))")).count()
    assert own.agg(F.max("count")).first()[0] <= 25


def test_large_polygons_go_by_bins(spark):
    left, right = shapes.random_polygons(41, 20, 50, 12), shapes.random_polygons(42, 15, 50, 25)
    want = {(a, b) for a, ra in left for b, rb in right if shapes.polygons_meet(ra, rb)}
    frames = shapes.features_frame(spark, left), shapes.features_frame(spark, right)
    for direct in (0, 40, 10**6):
        got = cov.features_intersect(*frames, 16.0, direct_pairs=direct).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert {tuple(r) for r in cov.features_intersect(frames[0], frames[0], 16.0, ordered=True).collect()} == {
        (a, b) for a, ra in left for b, rb in left if a < b and shapes.polygons_meet(ra, rb)}


def few_edged(seed, n, side, radii):
    """Boxes, triangles, boxes with a hole, pairs of boxes, lines and points of several sizes."""
    rng, out = random.Random(seed), []
    for fid in range(n):
        x, y, r = rng.randrange(side), -rng.randrange(side), rng.choice(radii)
        box, hole, moved = ([(x + m + s * a, y + s * b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
                            for s, m in ((r, 0), (r / 2, 0), (r, 3 * r)))
        out.append((fid, [[box], [box[:3] + box[:1]], [box, hole], [box, moved], [box[:2]], [box[:1]]][fid % 6]))
    return out


@pytest.mark.parametrize("radii", [(1, 2, 3), (0.01, 2, 64)])
def test_many_polygons_of_few_edges_are_compared_as_columns(spark, radii):
    """Sizes far apart share no square; other polygons, and those that seem to be twice, are compared as before."""
    few = few_edged(1, 90, 40, radii)
    polygons = few + [(1000 + f, rings) for f, rings in shapes.random_polygons(3, 6, 40, 8)]
    closed = {f: [r + r[-2::-1] if len(r) == 2 else r * 2 if len(r) == 1 else r for r in rings] for f, rings in polygons}
    want = {(a, b) for a, x in closed.items() for b, y in closed.items() if shapes.polygons_meet(x, y)}
    features = shapes.features_frame(spark, polygons)
    got = [tuple(r) for r in cov.features_intersect(features, features, 8.0, compiled_from=0).collect()]
    assert len(got) == len(want) and set(got) == want
    for more in ({"direct_pairs": 20}, {"direct_pairs": 0}):
        got = [tuple(r) for r in cov.features_intersect(features, features, 8.0, ordered=True, compiled_from=0, **more).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if p[0] < p[1]}
    twice = cov.known_unique(features.unionByName(features.where("fid < 9")))
    a, b = (sorted(map(tuple, cov.features_intersect(twice, features, 8.0, compiled_from=k).collect())) for k in (0, 1 << 62))
    assert a == b and set(a) == want


def test_many_pairs_are_not_sent_for_their_polygons(spark):
    """Polygons of few edges are shuffled by square, with their edges; no pair of ids is shuffled to fetch them."""
    features = cov.known_unique(shapes.features_frame(spark, few_edged(2, 60, 40, (1, 2))))
    found = cov.features_intersect(features, features, 8.0, ordered=True, compiled_from=0)
    text = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*?), \d+\)", text.split("Initial Plan")[-1])
    assert keys and all("rx" in k or k.startswith("fid") for k in keys) and "a_rings" not in text
