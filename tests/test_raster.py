"""Raster operators: cutting, stitching, masks, crops, resampling."""

import random

import pytest
import shapes
from pyspark.sql import functions as F

from tilequarry.operators import layout, raster
from tilequarry.plans import pipelines

SCHEMA = ("dataset_uid string, px int, py int, x0 double, y0 double, cell_w double, cell_h double, "
          "b1 double, b2 double")


def cell_rows(uid, x0, y0, w, h, size=1.0, seed=0, keep=lambda x, y: True):
    rng = random.Random(seed)
    return [(uid, x, y, float(x0), float(y0), size, size, None if rng.random() < 0.2 else float(rng.randint(0, 99)),
             float(x + 100 * y)) for y in range(h) for x in range(w) if keep(x, y)]


@pytest.fixture(scope="module")
def cells(spark):
    rows = (cell_rows("a", 0, 0, 24, 20, seed=1) + cell_rows("b", 24, 0, 13, 9, seed=2)
            + cell_rows("c", 2, -3, 17, 17, seed=3, keep=lambda x, y: (x * 7 + y * 3) % 11 != 0))
    return rows, layout.cell_center(spark.createDataFrame(rows, SCHEMA))


def values(df, *extra):
    return {(*[r[e] for e in extra], r.dataset_uid, r.px, r.py): (r.b1, r.b2) for r in df.collect()}


def test_cut_then_uncut_is_the_identity(spark, cells):
    rows, frame = cells
    tiles = raster.assemble_tiles(frame, ["b1", "b2"], 8)
    sizes = tiles.selectExpr("size(bands) AS n", "size(bands[0]) AS m", "size(bands[1]) AS k").distinct().collect()
    assert [tuple(s) for s in sizes] == [(2, 64, 64)]
    back = values(raster.tile_cells(tiles, ["b1", "b2"], 8))
    want = {(r[0], r[1], r[2]): (r[7], r[8]) for r in rows}
    assert {k: v for k, v in back.items() if k in want} == want
    assert all(v == (None, None) for k, v in back.items() if k not in want)


def test_mask_is_exact_for_random_regions(spark, cells):
    rows, frame = cells
    polygons = shapes.random_polygons(21, 12, 36, 14, (-2.0, 2.0))
    polygons.append((99, [[(-50.0, 50.0), (90.0, 50.0), (90.0, -70.0), (-50.0, -70.0), (-50.0, 50.0)]]))
    regions = shapes.features_frame(spark, polygons)
    cut = layout.cut_to_grid(frame, 8)
    spans = raster.mask_spans(layout.footprints(frame, 8), regions, 8, 10.0)
    got = [(r.region_id, r.dataset_uid, r.px, r.py) for r in raster.mask_cells(cut, spans).collect()]
    want = {(fid, r[0], r[1], r[2]) for fid, rings in polygons for r in rows
            if shapes.inside((r[3] + r[1] + 0.5, r[4] - r[2] - 0.5), rings)}
    assert len(got) == len(want) and set(got) == want

    tiles = raster.assemble_tiles(frame, ["b1", "b2"], 8)
    masked = raster.mask_tiles(tiles, spans, 8)
    kept = masked.select("region_id", "dataset_uid", *[c for c in tiles.columns if c != "dataset_uid"])
    seen = set()
    for region in {r.region_id for r in kept.select("region_id").collect()}:
        back = raster.tile_cells(kept.where(F.col("region_id") == region), ["b1", "b2"], 8)
        seen |= {(region, r.dataset_uid, r.px, r.py) for r in back.where("b2 IS NOT NULL").collect()}
    assert seen == want


def test_centres_on_an_edge_follow_the_ray_rule(spark):
    rows = cell_rows("a", 0, 0, 8, 8)
    frame = layout.cell_center(spark.createDataFrame(rows, SCHEMA))
    box = [[(1.5, -1.5), (5.5, -1.5), (5.5, -5.5), (1.5, -5.5), (1.5, -1.5)]]
    spans = raster.mask_spans(layout.footprints(frame, 8), shapes.features_frame(spark, [(1, box)]), 8, 10.0)
    got = {(r.px, r.py) for r in raster.mask_cells(layout.cut_to_grid(frame, 8), spans).collect()}
    assert got == {(x, y) for x in range(8) for y in range(8) if shapes.inside((x + 0.5, -y - 0.5), box)}


def test_crop_keeps_the_box_and_blanks_the_rest(spark, cells):
    rows, frame = cells
    polygons = [(1, [[(2.25, -1.25), (15.25, -4.0), (9.0, -14.75), (2.25, -1.25)]])]
    out = raster.crop_cells(layout.cut_to_grid(frame, 8), layout.footprints(frame, 8),
                            shapes.features_frame(spark, polygons), ["b1", "b2"], 8, 10.0)
    got = values(out)
    rings = polygons[0][1]
    want = {}
    for r in rows:
        x, y = r[3] + r[1] + 0.5, r[4] - r[2] - 0.5
        if 2.25 <= x < 15.25 and -14.75 <= y < -1.25:
            want[(r[0], r[1], r[2])] = (r[7], r[8]) if shapes.inside((x, y), rings) else (None, None)
    assert got == want


def test_mosaic_takes_the_first_value_where_datasets_overlap(spark, cells):
    rows, frame = cells
    got = {(r.gx, r.gy): (r.b1, r.b2) for r in raster.mosaic(frame, ["b1", "b2"], 0.0, 0.0, 8).collect()}
    want = {}
    for r in sorted(rows):
        key = (int(r[3]) + r[1], int(-r[4]) + r[2])
        old = want.get(key, (None, None))
        want[key] = tuple(o if o is not None else n for o, n in zip(old, (r[7], r[8])))
    assert got == want


def test_bilinear_reproduces_a_plane(spark):
    rows = [("a", x, y, 0.0, 0.0, 1.0, 1.0, 3.0 * x + 5.0 * y, None) for x in range(9) for y in range(7)]
    out = raster.resample_bilinear(spark.createDataFrame(rows, SCHEMA), ["b1"], 0.25, 0.5).collect()
    assert len(out) == 63
    for r in out:
        if r.n_b1 == 4:
            assert r.b1 == 3.0 * (r.px + 0.25) + 5.0 * (r.py + 0.5)
    with pytest.raises(ValueError):
        raster.resample_bilinear(spark.createDataFrame(rows, SCHEMA), ["b1"], 1.0, 0.0)


def test_reprojection_keeps_a_plane_and_makes_each_cell_once(spark):
    rows = [("a", x, y, 300000.0, 1500000.0, 10.0, 10.0, 2.0 * x, 3.0 * y) for x in range(40) for y in range(24)]
    frame = layout.cell_center(spark.createDataFrame(rows, SCHEMA))
    there = raster.reproject(frame, ["b1", "b2"], 32651, 3857, 10.0, 8)
    keys = there.groupBy("gx", "gy").count().where("count > 1").count()
    assert keys == 0 and there.count() > 900
    # Back to the source grid: interior cells return to within interpolation error.
    again = pipelines.reproject_cells(frame, ["b1", "b2"], 32651, 3857, 5.0, 8)
    back = raster.reproject(again, ["b1", "b2"], 3857, 32651, 10.0, 8).collect()
    checked = 0
    for r in back:
        x, y = r.gx - 30000, r.gy + 150000
        if 2 <= x < 38 and 2 <= y < 22:
            assert abs(r.b1 - 2.0 * x) < 0.02 and abs(r.b2 - 3.0 * y) < 0.02
            checked += 1
    assert checked == 36 * 20


def test_curve_order_with_small_blocks(spark):
    rows = [(u, c, r) for u in ("a", "b") for c in range(13) for r in range(9)]
    tiles = layout.with_tile_code(spark.createDataFrame(rows, "dataset_uid string, col int, row_ int"))
    ranked = layout.curve_order(tiles, block_bits=2).collect()
    for u in ("a", "b"):
        mine = sorted((r.sfc, r.pos) for r in ranked if r.dataset_uid == u)
        assert [p for _, p in mine] == list(range(1, 118))


def test_negative_keys_are_dropped_and_names_parse(spark):
    rows = [("a_x", c, r) for c in range(-2, 3) for r in range(-1, 3)]
    tiles = layout.drop_negative_keys(spark.createDataFrame(rows, "dataset_uid string, col int, row_ int"))
    coded = layout.with_tile_code(tiles, "zorder")
    from tilequarry.functions.scalars import parse_tile_name
    got = coded.select("col", "row_", "tile_code", *[c.alias("p_" + n) for n, c in parse_tile_name(F.col("file_name")).items()])
    for r in got.collect():
        assert (r.p_dataset_uid, r.p_tile_code, r.p_col, r.p_row_) == ("a_x", r.tile_code, r.col, r.row_)
    assert got.count() == 9


@pytest.mark.parametrize("width,height,target", [(32, 32, 2.0), (30, 30, 5.0)])
def test_reprojected_cells_do_not_depend_on_the_tile_size(spark, width, height, target):
    rows = [("a", x, y, 300000.0, 1500000.0, 10.0, 10.0, float(x + y), 1.0) for x in range(width) for y in range(height)]
    frame = layout.cell_center(spark.createDataFrame(rows, SCHEMA))
    found = [sorted(tuple(r) for r in raster.reproject(frame, ["b1"], 32651, 3857, target, tile).select("gx", "gy").collect())
             for tile in (8, 15, 32)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(set(found[0])) > width * height


def test_repeated_and_missing_cells_of_a_row(spark):
    rows = [("a", x, 0, 0.0, 0.0, 1.0, 1.0, b, 0.0) for x, b in ((0, 1.0), (0, 2.0), (2, 9.0))]
    tile = raster.assemble_tiles(layout.cell_center(spark.createDataFrame(rows, SCHEMA)), ["b1"], 4).first()
    assert tile.bands[0] == [1.0, None, 9.0] + [None] * 13
