"""Scenes on a common grid, fragments, mosaics of stored tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import plan
from test_raster import SCHEMA, cell_rows
from test_sources import write_tiff

from tilequarry.operators import layout, raster, scenes
from tilequarry.plans import pipelines
from tilequarry.sources import geotiff, tables

BANDS = ["b1", "b2"]


def by_hand(rows, x0, y0):
    """Cells of the common grid: band by band the first scene by name with a value."""
    out = {}
    for uid, px, py, ox, oy, size, _, *values in sorted(rows, key=lambda r: r[0]):
        cell = out.setdefault((round((ox - x0) / size) + px, round((y0 - oy) / size) + py), [None] * len(values))
        for i, v in enumerate(values):
            cell[i] = v if cell[i] is None else cell[i]
    return {k: tuple(v) for k, v in out.items()}


def cells_of(tiles, ts):
    """Cells with a value of any band."""
    rows = raster.tile_cells(tiles, BANDS, ts).where("b1 IS NOT NULL OR b2 IS NOT NULL").collect()
    assert len({(r.px, r.py) for r in rows}) == len(rows)
    return {(r.px, r.py): (r.b1, r.b2) for r in rows}


@pytest.fixture(scope="module")
def overlapping(spark):
    rows = (cell_rows("b", 10, 5, 21, 17, seed=1) + cell_rows("a", 0, 0, 16, 16, seed=2)
            + cell_rows("c", 16, 0, 8, 8, seed=3) + cell_rows("d", 40, -24, 8, 8, seed=4))
    return rows, layout.cell_center(spark.createDataFrame(rows, SCHEMA))


def test_layer_of_overlapping_scenes(spark, overlapping):
    rows, frame = overlapping
    tiles = scenes.layer_from_scenes(frame, BANDS, "all", tile_size=8)
    assert cells_of(tiles, 8) == by_hand(rows, 0.0, 5.0)
    assert {r.dataset_uid for r in tiles.select("dataset_uid").collect()} == {"all"}
    sizes = layout.curve_sizes(tiles).first().bits
    assert scenes.grid_sizes(scenes.common_grid(scenes.scene_headers(frame), "all", 8)).first().bits == sizes


def test_repeated_cells_and_null_bands(spark, overlapping):
    rows, frame = overlapping
    twice = scenes.layer_from_scenes(frame.union(frame), BANDS, "all", tile_size=8)
    assert cells_of(twice, 8) == by_hand(rows, 0.0, 5.0)
    blank = [(*r[:7], None, r[8]) if r[0] == "a" else r for r in rows]
    tiles = scenes.layer_from_scenes(layout.cell_center(spark.createDataFrame(blank, SCHEMA)), BANDS, "all", tile_size=8)
    assert cells_of(tiles, 8) == by_hand(blank, 0.0, 5.0)


def test_no_scene_gives_no_tile(spark):
    none = layout.cell_center(spark.createDataFrame([], SCHEMA))
    assert scenes.layer_from_scenes(none, BANDS, "all", tile_size=8).count() == 0


@pytest.mark.parametrize("other, message", [
    (cell_rows("z", 0.5, 0, 4, 4), "not on the grid"), (cell_rows("z", 0, 0, 4, 4, size=2.0), "one cell_w")])
def test_scenes_that_do_not_fit_fail(spark, overlapping, other, message):
    rows, _ = overlapping
    frame = layout.cell_center(spark.createDataFrame(rows + other, SCHEMA))
    with pytest.raises(Exception, match=message):
        scenes.layer_from_scenes(frame, BANDS, "all", tile_size=8).count()


def test_mosaic_of_stored_tiles(spark, overlapping, tmp_path):
    rows, frame = overlapping
    tables.write_tiles(pipelines.tile_raster(frame, BANDS, tile_size=8), str(tmp_path / "tiles"))
    stored = tables.read_tiles(spark, str(tmp_path / "tiles"))
    merged = scenes.mosaic_tiles(stored, 2, "all", 8)
    assert cells_of(merged, 8) == by_hand(rows, 0.0, 5.0)
    assert merged.select("col", "row_").distinct().count() == merged.count()


def test_tiles_that_meet_no_other_are_not_shuffled(spark, tmp_path):
    """Scenes side by side on one grid: no band goes through an exchange."""
    rows = cell_rows("a", 0, 0, 16, 16, seed=2) + cell_rows("b", 16, 0, 8, 8, seed=3)
    frame = layout.cell_center(spark.createDataFrame(rows, SCHEMA))
    tables.write_tiles(pipelines.tile_raster(frame, BANDS, tile_size=8), str(tmp_path / "tiles"))
    stored = tables.read_tiles(spark, str(tmp_path / "tiles"))
    merged = scenes.mosaic_tiles(stored, 2, "all", 8)
    untouched = plan(merged).split("Union")[1].split("ObjectHashAggregate")[0].split("SortAggregate")[0]
    assert "bands" in untouched and "BroadcastHashJoin" in untouched and "hashpartitioning" not in untouched
    assert cells_of(merged, 8) == by_hand(rows, 0.0, 0.0)


def random_fragments(seed, ts, side, count):
    rng = random.Random(seed)
    out, want = [], {}
    for n in range(count):
        w, h = rng.randint(1, ts), rng.randint(1, ts)
        col, row = rng.randrange(side), rng.randrange(side)
        lx, ly, band = rng.randint(0, ts - w), rng.randint(0, ts - h), rng.randint(1, 2)
        vals = [None if rng.random() < 0.3 else float(rng.randint(0, 9)) for _ in range(w * h)]
        out.append(("all", f"s{n:03d}", col, row, 0.0, 0.0, 1.0, 1.0, band, lx, ly, w, h, vals))
        for i, v in enumerate(vals):
            at = (band, col * ts + lx + i % w, row * ts + ly + i // w)
            if v is not None:
                want.setdefault(at, v)
    return out, want


@pytest.mark.parametrize("seed", range(3))
def test_fragments_in_any_place(spark, seed):
    rows, want = random_fragments(seed, 5, 2, 25)
    tiles = scenes.assemble_fragments(spark.createDataFrame(rows, geotiff.FRAGMENTS), 2, 5)
    got = cells_of(tiles, 5)
    assert {(b + 1, *k): v for k, values in got.items() for b, v in enumerate(values) if v is not None} == want
    assert {(len(r.bands), len(r.bands[0]), len(r.bands[1])) for r in tiles.collect()} == {(2, 25, 25)}


@pytest.mark.parametrize("options", [dict(rows_per_strip=3), dict(tile=16), dict(tile=16, planar=2), {}])
def test_geotiff_fragments_equal_cells(spark, tmp_path, options):
    rng = np.random.default_rng(5)
    for name, x0 in (("a", 300000.0), ("b", 300170.0)):
        write_tiff(tmp_path / f"{name}.tif", rng.integers(0, 50, (21, 37, 2)).astype("int16"), nodata=7, x0=x0, **options)
    path = f"file://{tmp_path}"
    cells = geotiff.read_geotiff(spark, path, 2)
    want = {(r.dataset_uid, r.col, r.row_): r.bands for r in raster.assemble_tiles(cells, BANDS, 8).collect()}
    tiles = scenes.assemble_fragments(geotiff.read_fragments(spark, path, 8), 2, 8)
    assert {(r.dataset_uid, r.col, r.row_): r.bands for r in tiles.collect()} == want
    assert plan(tiles).split("Initial Plan")[0].count("MapInPandas") == 2  # headers and pixels, each once

    layer = scenes.layer_from_scenes(cells, BANDS, "all", tile_size=8)
    fragments, grid = geotiff.read_layer_fragments(spark, path, "all", 8)
    assert grid.first().epsg == 32651
    merged = scenes.layer_from_fragments(fragments, 2, grid, tile_size=8)
    columns = ["col", "row_", "sfc", "file_name", "xmin", "ymax", "bands"]
    assert sorted(merged.select(columns).collect()) == sorted(layer.select(columns).collect())


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, value in (("p", 1), ("q", 2)):
        (tmp_path / folder).mkdir()
        write_tiff(tmp_path / folder / "s.tif", np.full((4, 4, 1), value, dtype="uint8"))
    write_tiff(tmp_path / "t.v1.tif", np.full((4, 4, 1), 3, dtype="uint8"))
    found = geotiff.read_geotiff(spark, f"file://{tmp_path}", 1).groupBy("dataset_uid").agg(F.min("b1"), F.max("b1"), F.count("*"))
    rows = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert rows.pop("t.v1") == (3.0, 3.0, 16)
    assert all(k.startswith("s-") for k in rows) and sorted(rows.values()) == [(1.0, 1.0, 16), (2.0, 2.0, 16)]
