"""Stored tiles: envelopes become runs of the curve and predicates of the scan."""

import random
import re

import pytest
import shapes
from pyspark.sql import functions as F
from test_sources import stored_tiles

from tilequarry.functions import sfc
from tilequarry.operators import layout, pruning
from tilequarry.plans import pipelines
from tilequarry.sources import tables


@pytest.mark.parametrize("curve", ["hilbert", "zorder"])
def test_runs_of_the_curve_hold_a_rectangle(curve):
    rng = random.Random(1)
    for bits in (1, 3, 5):
        side = 1 << bits
        codes = {(c, r): sfc.position(curve, c, r, bits) for c in range(side) for r in range(side)}
        assert sorted(codes.values()) == list(range(side * side))
        for _ in range(40):
            c1, c2 = sorted(rng.randrange(-2, side + 2) for _ in "ab")
            r1, r2 = sorted(rng.randrange(-2, side + 2) for _ in "ab")
            want = {v for (c, r), v in codes.items() if c1 <= c <= c2 and r1 <= r <= r2}
            exact = sfc.code_ranges(curve, (c1, c2), (r1, r2), bits, 10**6)
            assert {v for a, b in exact for v in range(a, b + 1)} == want
            assert all(b + 1 < c for (_, b), (c, _) in zip(exact, exact[1:]))
            few = sfc.code_ranges(curve, (c1, c2), (r1, r2), bits, 4)
            assert want <= {v for a, b in few for v in range(a, b + 1)} and len(few) <= 16
    with pytest.raises(ValueError):
        sfc.code_ranges("peano", (0, 1), (0, 1), 2)


def test_positions_are_those_of_the_columns(spark):
    keys = spark.range(256).selectExpr("int(id % 16) AS c", "int(id div 16) AS r")
    rows = keys.select("c", "r", *[sfc.sfc_encode(k, F.col("c"), F.col("r"), F.lit(4)).alias(k) for k in ("hilbert", "zorder")]).collect()
    assert all(r[k] == sfc.position(k, r.c, r.r, 4) for r in rows for k in ("hilbert", "zorder"))


def test_pruned_tiles_are_those_that_overlap(spark, tmp_path):
    tiles = stored_tiles(spark, str(tmp_path / "tiles"))
    layouts = layout.stored_layouts(tiles)
    rows = tiles.select("dataset_uid", "col", "row_", "xmin", "ymin", "xmax", "ymax").collect()
    rng = random.Random(2)
    for _ in range(12):
        xmin, ymin = rng.uniform(-10, 120), rng.uniform(-70, 5)
        box = (xmin, ymin, xmin + rng.choice([0.5, 8.0, 40.0]), ymin + rng.choice([0.5, 16.0, 30.0]))
        want = {r[:3] for r in rows if r.xmin < box[2] and r.xmax > box[0] and r.ymin < box[3] and r.ymax > box[1]}
        for known in (layouts, None):
            assert {tuple(r) for r in pruning.tiles_under(tiles, box, known).select("dataset_uid", "col", "row_").collect()} == want
    assert pruning.tiles_under(tiles, None, layouts).count() == 0
    assert pruning.tiles_under(tiles, (8.0, -16.0, 16.0, -8.0), layouts).count() == 1


def test_many_datasets_are_left_to_the_sides(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pruning, "NAMED_DATASETS", 1)
    tiles = stored_tiles(spark, str(tmp_path / "tiles"))
    assert pruning.tiles_under(tiles, (60.0, -9.0, 70.0, -1.0), layout.stored_layouts(tiles)).count() == 4


def scans_with_bands(df):
    """Texts of the scans that read bands, and of all that is above them in the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = lambda line: len(re.match(r"[\s:|+\-]*", line).group())
    found = []
    for i, line in enumerate(text):
        if "FileScan" in line and "bands" in line.split("ReadSchema")[-1]:
            above, d = [], depth(line)
            for up in reversed(text[:i]):
                if depth(up) < d:
                    above.append(up)
                    d = depth(up)
            found.append((line, above))
    return found


def test_predicates_reach_the_scan_and_no_exchange_moves_bands(spark, tmp_path):
    path = str(tmp_path / "layer")
    tables.write_layer(stored_tiles(spark, str(tmp_path / "tiles")), path, 4)
    tiles, layouts = tables.read_layer(spark, path)
    region = shapes.features_frame(spark, [(1, [[(66.0, -2.0), (90.0, -2.0), (78.0, -30.0), (66.0, -2.0)]])])
    found = pipelines.query_region_tiles(tiles, region, 8, layouts=layouts)
    (scan, above), = scans_with_bands(found)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan).group(1)
    for f in ("LessThan(xmin,90.0)", "GreaterThan(xmax,66.0)", "LessThan(ymin,-2.0)", "GreaterThan(ymax,-30.0)", "sfc"):
        assert f in pushed, f
    assert "00000002" in re.search(r"PartitionFilters: \[(.*?)\]", scan).group(1)
    assert above and not any("Exchange" in line or "ShuffleQueryStage" in line for line in above)
    cells = {(r.dataset_uid, r.col, r.row_) for r in found.collect()}
    assert cells and all(u == "00000002" for u, _, _ in cells)
    everything = pipelines.query_region_tiles(tiles, region, 8)
    key = lambda r: (r.dataset_uid, r.col, r.row_, str(r.bands))
    assert sorted(map(key, everything.collect())) == sorted(map(key, found.collect()))
