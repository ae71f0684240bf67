"""Polygons with parts and holes: nesting, and reading what was written."""

import json

import pytest

from tilequarry.operators import features as ft
from tilequarry.sources import geojson, tables


def box(x1, y1, x2, y2):
    return [[float(x), float(y)] for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]


SHELL, HOLE, ISLAND, POND = box(0, 0, 20, 20), box(2, 2, 18, 18), box(4, 4, 16, 16), box(6, 6, 8, 8)
DIAMOND = [[10.0, 20.0], [20.0, 10.0], [10.0, 0.0], [0.0, 10.0], [10.0, 20.0]]

# Multipolygons whose parts are known, and the order their rings may come in.
PARTS = {
    "apart": [[box(0, 0, 1, 1)], [box(5, 5, 6, 6)]],
    "hole": [[SHELL, HOLE]],
    "two holes": [[SHELL, box(1, 1, 3, 3), box(5, 5, 7, 7)], [box(30, 0, 31, 1)]],
    "island in a hole with a pond": [[SHELL, HOLE], [ISLAND, POND]],
    "hole that touches its shell with every vertex": [[SHELL, DIAMOND]],
    "parts that share a corner": [[box(0, 0, 2, 2)], [box(2, 2, 4, 4)]],
    "neighbours with an edge in common": [[box(0, 0, 2, 2)], [box(2, 0, 4, 2)]],
    "envelope inside, ring outside": [[[[0.0, 0.0], [20.0, 0.0], [20.0, 20.0], [18.0, 20.0], [18.0, 2.0], [0.0, 2.0], [0.0, 0.0]]],
                                      [box(3, 5, 6, 8)]],
}
OTHERS = {
    "Point": [1.5, 2.0], "MultiPoint": [[1.0, 2.0], [3.0, 4.0]], "LineString": [[0.0, 0.0], [1.0, 1.0]],
    "MultiLineString": [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]], "Polygon": [SHELL, HOLE],
}


def frame(spark, rows):
    data = [(i, "MultiPolygon", [[{"x": x, "y": y} for x, y in r] for r in rings], {"UID": str(i)}) for i, rings in rows]
    return spark.createDataFrame(
        data, "fid bigint, geom_type string, rings array<array<struct<x:double,y:double>>>, attrs map<string,string>")


def written(spark, rows):
    return {r.fid: json.loads(r.geometry)["coordinates"] for r in ft.to_geojson(frame(spark, rows), "UID").collect()}


def test_rings_are_nested_whatever_their_order(spark):
    rows, want = [], {}
    for i, parts in enumerate(PARTS.values()):
        rings = [r for p in parts for r in p]
        rows += [(2 * i, rings), (2 * i + 1, rings[::-1])]
        want[2 * i] = want[2 * i + 1] = parts
    got = written(spark, rows)
    order = lambda parts: sorted([p[0], *sorted(p[1:])] for p in parts)
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in want.items()}
    assert all(got[2 * i] == p for i, p in enumerate(PARTS.values()))


@pytest.mark.parametrize("rings", [
    [], [SHELL], [SHELL, SHELL], [box(0, 4, 20, 8), box(4, 0, 8, 20)], [SHELL, box(10, 10, 30, 30), box(11, 11, 12, 12)]])
def test_no_ring_is_lost_or_doubled(spark, rings):
    got = written(spark, [(1, rings)])[1]
    assert sorted(r for p in got for r in p) == sorted(rings)


def test_read_write_read_is_the_identity(spark, tmp_path):
    shapes = [("MultiPolygon", p) for p in PARTS.values()] + list(OTHERS.items())
    lines = [json.dumps({"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"UID": i, "name": 'a "b"\n'}})
             for i, (k, c) in enumerate(shapes)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    first = geojson.read_geojson_lines(spark, str(tmp_path / "in.jsonl"), "UID")
    tables.write_geojson_lines(ft.to_geojson_lines(first), str(tmp_path / "out"))
    second = geojson.read_geojson_lines(spark, str(tmp_path / "out"), "UID")
    rows = lambda df: sorted(df.collect(), key=lambda r: r.fid)
    assert rows(first) == rows(second) and first.count() == len(shapes)
    again = sorted(json.loads(r.line)["properties"]["UID"] + json.dumps(json.loads(r.line)["geometry"]["coordinates"])
                   for r in ft.to_geojson_lines(second).collect())
    assert again == sorted(str(i) + json.dumps(c) for i, (_, c) in enumerate(shapes))
