"""Readers and writers, with small files written by the tests."""

import json
import re
import struct

import numpy as np
import pytest
import shapes
from pyspark.sql import functions as F

from tilequarry.operators import documents, index, layout, raster
from tilequarry.sources import geojson, geotiff, tables


def write_tiff(path, data, order="<", tile=None, rows_per_strip=None, planar=1, nodata=None, epsg=32651,
               x0=300000.0, y0=1500000.0, cell=10.0):
    """Minimal uncompressed GeoTIFF; data is (height, width, bands)."""
    height, width, bands = data.shape
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    out = data.astype(data.dtype.newbyteorder(order))
    planes = [out] if planar == 1 else [out[:, :, i:i + 1] for i in range(bands)]
    blocks = []
    for plane in planes:
        if tile:
            for r in range(0, height, tile):
                for c in range(0, width, tile):
                    block = np.zeros((tile, tile, plane.shape[2]), dtype=out.dtype)
                    part = plane[r:r + tile, c:c + tile]
                    block[:part.shape[0], :part.shape[1]] = part
                    blocks.append(block.tobytes())
        else:
            step = rows_per_strip or height
            blocks += [plane[r:r + step].tobytes() for r in range(0, height, step)]
    offsets, position = [], 8
    for b in blocks:
        offsets.append(position)
        position += len(b)
    sizes = [len(b) for b in blocks]
    entries = [(256, 3, [width]), (257, 3, [height]), (258, 3, [out.dtype.itemsize * 8] * bands), (259, 3, [1]),
               (277, 3, [bands]), (284, 3, [planar]), (339, 3, [kind] * bands),
               (33550, 12, [cell, cell, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]),
               (34735, 3, [1, 1, 0, 1, 3072, 0, 1, epsg])]
    entries += ([(322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, sizes)] if tile else
                [(273, 4, offsets), (278, 3, [rows_per_strip or height]), (279, 4, sizes)])
    if nodata is not None:
        entries.append((42113, 2, str(nodata)))
    codes = {3: "H", 4: "I", 12: "d"}
    body, extra = b"", b""
    start = position + 2 + 12 * len(entries) + 4
    for tag, kind_, values in sorted(entries, key=lambda e: e[0]):
        raw = values.encode() + b"\0" if kind_ == 2 else struct.pack(f"{order}{len(values)}{codes[kind_]}", *values)
        n = len(raw) if kind_ == 2 else len(values)
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, kind_, n, start + len(extra))
            extra += raw
        else:
            body += struct.pack(order + "HHI", tag, kind_, n) + raw.ljust(4, b"\0")
    with open(path, "wb") as f:
        f.write((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, position))
        f.write(b"".join(blocks))
        f.write(struct.pack(order + "H", len(entries)) + body + struct.pack(order + "I", 0) + extra)


@pytest.mark.parametrize("options", [
    dict(rows_per_strip=4), dict(tile=16), dict(tile=16, planar=2), dict(order=">", rows_per_strip=5, planar=2), {}])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32"])
def test_geotiff(spark, tmp_path, options, dtype):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 100, (21, 37, 2)).astype(dtype)
    write_tiff(tmp_path / "scene_1.tif", data, nodata=7, **options)
    got = geotiff.read_geotiff(spark, f"file://{tmp_path}", 2).collect()
    assert len(got) == 21 * 37
    for r in got:
        want = [None if v == 7 else float(v) for v in data[r.py, r.px]]
        assert [r.b1, r.b2] == want and r.dataset_uid == "scene_1" and r.epsg == 32651
    assert (got[0].cx, got[0].cy) == (300000 + 10 * got[0].px + 5, 1500000 - 10 * got[0].py - 5)


def test_geotiff_blocks_are_rows_of_their_own(spark, tmp_path):
    write_tiff(tmp_path / "a.tif", np.zeros((64, 8, 1), dtype="uint8"), rows_per_strip=4)
    assert geotiff.geotiff_blocks(spark, f"file://{tmp_path}").count() == 16


def test_geotiff_to_tiles(spark, tmp_path):
    data = np.arange(20 * 12, dtype="int16").reshape(20, 12, 1)
    write_tiff(tmp_path / "t.tif", data, rows_per_strip=3)
    cells = geotiff.read_geotiff(spark, f"file://{tmp_path}", 1)
    sums = {(r.col, r.row_): r.total for r in raster.tile_digest(raster.assemble_tiles(cells, ["b1"], 8), 1).collect()}
    assert sums == {(c, r): float(data[8 * r:8 * r + 8, 8 * c:8 * c + 8].sum()) for c in range(2) for r in range(3)}


GEOMETRIES = {
    "Point": [1.5, 2.0], "MultiPoint": [[1.0, 2.0], [3.0, 4.0]], "LineString": [[0.0, 0.0], [1.0, 1.0]],
    "MultiLineString": [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]],
    "Polygon": [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]], [[1.0, 0.5], [2.0, 0.5], [2.0, 1.0], [1.0, 0.5]]],
    "MultiPolygon": [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]], [[[9.0, 9.0], [8.0, 9.0], [8.0, 8.0], [9.0, 9.0]]]],
}
RING_COUNTS = {"Point": [1], "MultiPoint": [1, 1], "LineString": [2], "MultiLineString": [2, 2], "Polygon": [4, 4],
               "MultiPolygon": [4, 4]}


@pytest.mark.parametrize("lines", [True, False])
def test_geojson(spark, tmp_path, lines):
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c},
                 "properties": {"UID": i, "name": k, "gone": None}} for i, (k, c) in enumerate(GEOMETRIES.items())]
    if lines:
        (tmp_path / "f.geojsonl").write_text("\n".join(json.dumps(f) for f in features))
        got = geojson.read_geojson_lines(spark, str(tmp_path), "UID")
    else:
        (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
        got = geojson.read_geojson(spark, str(tmp_path), "UID")
    rows = {r.geom_type: r for r in got.collect()}
    assert set(rows) == set(GEOMETRIES)
    for i, kind in enumerate(GEOMETRIES):
        assert rows[kind].fid == i and rows[kind].attrs == {"UID": str(i), "name": kind}
        assert [len(r) for r in rows[kind].rings] == RING_COUNTS[kind]
    assert (rows["Point"].rings[0][0].x, rows["Point"].rings[0][0].y) == (1.5, 2.0)


def test_geojson_without_an_id_gets_a_stable_one(spark, tmp_path):
    feature = {"geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"a": "b"}}
    (tmp_path / "f.jsonl").write_text(json.dumps(feature))
    ids = {geojson.read_geojson_lines(spark, str(tmp_path)).first().fid for _ in range(2)}
    assert len(ids) == 1 and None not in ids


def stored_tiles(spark, path):
    rows = [(u, x, y, o, 0.0, 1.0, 1.0, float(x), 1.0) for u, o in (("00000001", 0.0), ("00000002", 64.0))
            for x in range(64) for y in range(64)]
    cells = layout.cell_center(spark.createDataFrame(
        rows, "dataset_uid string, px int, py int, x0 double, y0 double, cell_w double, cell_h double, b1 double, b2 double"))
    tiles = layout.with_tile_code(raster.assemble_tiles(cells, ["b1", "b2"], 8))
    tables.write_tiles(tiles, path, 4)
    return tables.read_tiles(spark, path)


def test_tiles_on_disk(spark, tmp_path):
    path = str(tmp_path / "tiles")
    tiles = stored_tiles(spark, path)
    assert tiles.count() == 128
    assert {r[0] for r in tiles.select("dataset_uid").distinct().collect()} == {"00000001", "00000002"}
    one = tables.read_tiles(spark, path, ["00000002"])
    assert one.count() == 64
    filters = re.search(r"PartitionFilters: \[(.*?)\]", one._jdf.queryExecution().toString()).group(1)
    assert "00000002" in filters
    assert sorted(r.tile_code for r in one.select("tile_code").collect())[:2] == ["00000000", "00000001"]


def test_documents_postings_and_mosaic_on_disk(spark, tmp_path):
    rows = shapes.tile_rows("0007", 0, 0, 8, 8, 3, 3)
    tiles = layout.with_tile_code(spark.createDataFrame(rows, shapes.TILE_SCHEMA))
    features = shapes.features_frame(spark, shapes.random_polygons(4, 9, 20, 6), UID=str)
    docs = documents.tile_documents(tiles, features, 16.0)
    tables.write_documents(docs, str(tmp_path / "docs"))
    back = tables.read_documents(spark, str(tmp_path / "docs"))
    assert {(r.dataset_uid, r.doc) for r in back.collect()} == {(r.dataset_uid, r.doc) for r in docs.collect()}

    folder = tmp_path / "json"
    folder.mkdir()
    for r in docs.collect():
        (folder / r.doc_path.rsplit("/", 1)[-1]).write_text(r.doc)
    read = documents.parse_documents(tables.read_document_files(spark, str(folder)))
    assert read.count() == docs.agg(F.sum("n_features")).first()[0]
    postings = index.postings_from_documents(read)
    tables.write_postings(postings, str(tmp_path / "postings"))
    assert spark.read.parquet(str(tmp_path / "postings")).count() == postings.count()
    text = str(tmp_path / "index")
    tables.write_index_text(index.render_text(postings), text)
    assert set(map(tuple, index.load_text(tables.read_index_text(spark, text)).collect())) == set(
        map(tuple, postings.select("kw", "doc_path", "tile_code", "dataset_uid").collect()))
    names = tables.list_files(spark, str(folder), ["json"])
    assert names.count() == 9 and tables.list_files(spark, str(folder), ["tif"]).count() == 0
