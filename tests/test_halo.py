"""Kernels over tiles and borders, cell types, document lines."""

import glob
import os
import random
import re

import pytest
import shapes
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tilequarry.catalog import queries
from tilequarry.operators import documents, halo, layout, raster, typed
from tilequarry.sources import tables

CELLS = "dataset_uid string, px int, py int, x0 double, y0 double, cell_w double, cell_h double, b1 double, b2 double"


def raster_rows(width, height, holes=0.2, uid="d", seed=3):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < holes else float(rng.randrange(4096))
    return [(uid, x, y, 0.0, 0.0, 1.0, 1.0, value(), value()) for x in range(width) for y in range(height)]


@pytest.mark.parametrize("dx, dy", [(0.25, 0.5), (0.0, 0.5), (0.75, 0.0), (0.0, 0.0)])
def test_resampled_tiles_equal_resampled_cells(spark, dx, dy):
    rows = raster_rows(13, 9) + raster_rows(4, 4, 0.9, "e", 4)
    cells = spark.createDataFrame(rows, CELLS)
    tiles = raster.assemble_tiles(cells, ["b1", "b2"], 4)
    moved = raster.tile_cells(halo.resample_bilinear_tiles(tiles, dx, dy, 4), ["b1", "b2"], 4)
    got = {(r.dataset_uid, r.px, r.py): (r.b1, r.b2) for r in moved.collect() if r.b1 is not None or r.b2 is not None}
    want = {(r.dataset_uid, r.px, r.py): (r.b1, r.b2) for r in raster.resample_bilinear(cells, ["b1", "b2"], dx, dy).collect()
            if r.b1 is not None or r.b2 is not None}
    assert got == want


def test_missing_neighbours_and_wrong_offsets(spark):
    cells = spark.createDataFrame([r for r in raster_rows(12, 12, 0) if not (4 <= r[1] < 8 and 4 <= r[2] < 8)], CELLS)
    tiles = raster.assemble_tiles(cells, ["b1", "b2"], 4)
    planes = {(r.col, r.row_): r.planes for r in halo.with_halo(tiles, 4).collect()}
    assert set(planes) == {(c, r) for c in range(3) for r in range(3)} - {(1, 1)}
    at = {(r[1], r[2]): r[7] for r in raster_rows(12, 12, 0)}
    corner = planes[(0, 0)][0]
    assert corner[4] == [at[(x, 4)] for x in range(4)] + [None] and [corner[y][4] for y in range(4)] == [at[(4, y)] for y in range(4)]
    with pytest.raises(ValueError):
        halo.resample_bilinear_tiles(tiles, 1.0, 0.0, 4)
    assert halo.resample_bilinear_tiles(tiles.limit(0), 0.5, 0.5, 4).count() == 0


def test_borders_not_cells_are_exchanged(spark):
    """Between the tiles and the kernel there is no row for a cell."""
    tiles, _ = queries.stored_layer(spark, SF_SMALL)
    text = halo.resample_bilinear_tiles(tiles, 0.25, 0.5, 8)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in text and len(re.findall(r"Generate inline", text)) == 1


def test_cell_types_round_trip(spark, tmp_path):
    tiles = layout.with_tile_code(raster.assemble_tiles(spark.createDataFrame(raster_rows(9, 9), CELLS), ["b1", "b2"], 4))
    want = {(r.col, r.row_): r.bands for r in tiles.collect()}
    for name, (stored, _, _) in typed.CELL_TYPES.items():
        held = tiles.withColumn("bands", F.expr("transform(bands, b -> transform(b, v -> v % 100))"))
        path = str(tmp_path / name)
        tables.write_tiles(typed.with_cell_type(held, name, 32651, 4), path)
        back = tables.read_tiles(spark, path)
        assert back.schema["bands"].dataType.simpleString() == f"array<array<{stored}>>"
        got = {(r.col, r.row_): r.bands for r in typed.as_doubles(back).collect()}
        assert got == {k: [[None if v is None else v % 100 for v in b] for b in bands] for k, bands in want.items()}
        assert [(r.epsg, r.cell_type, r.tile_size, r.n_tiles, r.cell_w) for r in typed.layer_metadata(back).collect()] == [(32651, name, 4, 9, 1.0)]
    with pytest.raises(ValueError):
        typed.with_cell_type(tiles, "complex", 32651, 4)
    for bad, name in ((300.0, "uint8"), (-1.0, "uint16"), (0.5, "int32")):
        row = tiles.limit(1).withColumn("bands", F.array(F.array(F.lit(bad))))
        with pytest.raises(Exception, match=f"no {name}"):
            typed.with_cell_type(row, name, 32651, 4).collect()


def test_layers_of_two_types_differ_in_that_field_and_mixed_ones_fail(spark):
    tiles = layout.with_tile_code(raster.assemble_tiles(spark.createDataFrame(raster_rows(8, 8), CELLS), ["b1", "b2"], 4))
    a, b = (typed.with_cell_type(tiles, t, e, 4) for t, e in (("uint16", 32651), ("float32", 32650)))
    found = typed.compare_layers(typed.layer_metadata(a), typed.layer_metadata(b)).collect()
    assert {r.field for r in found if not r.is_equal} == {"cell_type", "epsg"} and len(found) == len(typed.LAYER_FIELDS)
    missing = typed.compare_layers(typed.layer_metadata(a), typed.layer_metadata(b.limit(0))).collect()
    assert all(r.right_value is None and not r.is_equal for r in missing) and len(missing) == len(typed.LAYER_FIELDS)
    mixed = a.drop("bands").unionByName(b.drop("bands"))
    with pytest.raises(Exception, match="mixed"):
        typed.layer_metadata(mixed).collect()


def test_document_lines_are_the_documents(spark, tmp_path):
    rows = shapes.tile_rows("d1", 0, 0, 8, 8, 4, 4)
    tiles = layout.with_tile_code(spark.createDataFrame(rows, shapes.TILE_SCHEMA))
    polygons = shapes.random_polygons(2, 30, 26, 5) + [
        (fid, [[(1.0, -1.0), (2.0, -1.0), (2.0, -2.0), (1.0, -1.0)]]) for fid in range(100, 700)]
    features = shapes.features_frame(spark, polygons, UID=str, **{"na,me": lambda f: 'q"uote,', "tile_code": lambda f: "x\ny"})
    path = str(tmp_path / "docs")
    tables.write_document_lines(documents.document_lines(tiles, features, 16.0), path, partitions=7)
    want = {r.doc_path: r.doc for r in documents.tile_documents(tiles, features, 16.0).collect()}
    got, files = {}, 0
    for folder in glob.glob(f"{path}/dataset_uid=d1/doc_path=*"):
        parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
        files = max(files, len(parts))
        name = folder.split("doc_path=")[1].replace("%2F", "/")
        got[name] = "".join(open(os.path.join(folder, f)).read() for f in parts).rstrip("\n")
    assert got == want
    assert files > 1  # the crowded tile's document is cut, its files in order
    lines = tables.read_document_lines(spark, path)
    fields = ["doc_path", "tile_code", "dataset_uid", "attrs"]
    a = sorted(map(str, documents.parse_lines(lines).select(*fields).collect()))
    b = sorted(map(str, documents.parse_documents(documents.tile_documents(tiles, features, 16.0)).select(*fields).collect()))
    assert a == b


def test_short_documents_are_spread_and_read_together(spark, tmp_path):
    """Folders and texts as Spark would write them; each task writes short documents, and reads many."""
    rows = [("d+1 é", f"json/{i}%2F:a=b+c^'.json", place, None, f"{i} {place} ü") for i in range(400) for place in (0, 1)]
    rows += [(None, "json/x.json", 0, None, None), ("d2", "", 0, None, "x"), ("d2", "a\\b[c]{d}\"#*?", 0, None, ""), ("d2", "a", 0, None, "{},")]
    rows += [("d0", f"json/long{i % 60}.json", 1, i, f"line {i}") for i in range(1800)]
    lines = spark.createDataFrame(rows, "dataset_uid string, doc_path string, place int, fid long, line string")
    path, plain = str(tmp_path / "docs"), str(tmp_path / "plain")
    for _ in range(2):  # what was there goes
        tables.write_document_lines(lines, path, partitions=7)
    lines.coalesce(1).sortWithinPartitions("dataset_uid", "doc_path", "place", "fid").select("dataset_uid", "doc_path", "line").write.partitionBy(
        "dataset_uid", "doc_path").text(plain)

    def stored(at):
        texts, tasks = {}, {}
        for folder in glob.glob(f"{at}/dataset_uid=*/doc_path=*"):
            parts = sorted(f for f in os.listdir(folder) if not f.endswith(".crc"))
            texts[os.path.relpath(folder, at)] = b"".join(open(os.path.join(folder, f), "rb").read() for f in parts)
            for f in parts:
                tasks.setdefault(f.split("-")[1], []).append(folder)
        return texts, tasks

    (got, tasks), (want, _) = stored(path), stored(plain)
    assert got == want and os.path.exists(f"{path}/_SUCCESS")
    assert len(tasks) == 7 and all(sum("uid=d+1" in f for f in folders) > 20 for folders in tasks.values())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = tables.read_document_lines(spark, path)
        assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        back = sorted(map(repr, map(tuple, read.collect())))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert back == sorted(repr((r[0] or None, r[1] or None, r[4] or "")) for r in rows)
