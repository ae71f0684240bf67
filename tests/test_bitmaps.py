"""Postings as bitmaps against postings as rows."""

import random

import pytest
from pyspark.sql import functions as F

from tilequarry.operators import bitmaps, layout, search
from tilequarry.sources import tables


@pytest.fixture(scope="module")
def index_rows(spark):
    """Tiles of two datasets, one of 256 x 256 so that its curve has two blocks, and keywords by hand."""
    rng = random.Random(4)
    keys = [("d1", c, r) for c in range(256) for r in range(0, 256, 5)] + [("d2", c, r) for c in range(3) for r in range(3)] + [("d1", 255, 255)]
    tiles = layout.with_tile_code(spark.createDataFrame(keys, "dataset_uid string, col int, row_ int")).select(*layout.TILE_KEY, "sfc").cache()
    words = [(kw, *k) for k in keys for kw, share in (("all", 1), ("half", 0.5), ("few", 0.01)) if rng.random() < share]
    words += [("once", "d2", 2, 2), ("once", "d2", 2, 2), (None, "d2", 1, 1)]
    rows = spark.createDataFrame(words, "kw string, dataset_uid string, col int, row_ int").join(tiles, layout.TILE_KEY)
    return rows, tiles


def found(df):
    out = list(map(tuple, df.select(*layout.TILE_KEY).collect()))
    assert len(out) == len(set(out))
    return set(out)


def test_and_or_and_counts_equal_the_row_form(spark, index_rows, tmp_path):
    rows, tiles = index_rows
    path = str(tmp_path / "bitmaps")
    tables.write_bitmaps(bitmaps.build_bitmaps(rows), path)
    stored, sizes = spark.read.parquet(path), layout.curve_sizes(tiles)
    assert stored.where("kw = 'all' AND dataset_uid = 'd1'").count() == 2  # one row for each block
    for words in (["all", "half"], ["half", "few", "half"], ["once"], ["all", "nowhere"]):
        assert found(bitmaps.tiles_found(bitmaps.and_search(stored, words), sizes)) == found(search.search_all(rows, words))
    lenient = bitmaps.and_search(stored, ["few", "nowhere"], "lenient")
    assert found(bitmaps.tiles_found(lenient, sizes)) == found(search.search_all(rows, ["few", "nowhere"], "lenient"))
    some = bitmaps.tiles_found(bitmaps.or_search(stored, ["few", "once"]), sizes)
    assert found(some) == found(rows.where("kw IN ('few', 'once')").distinct())
    want = rows.where("kw IS NOT NULL").groupBy("kw").agg(F.count_distinct("dataset_uid", "sfc").alias("n"))
    assert set(map(tuple, bitmaps.tile_counts(stored).collect())) == set(map(tuple, want.collect()))


def test_search_reads_the_rows_of_its_keywords(spark, index_rows, tmp_path):
    path = str(tmp_path / "bitmaps")
    tables.write_bitmaps(bitmaps.build_bitmaps(index_rows[0]), path)
    text = bitmaps.and_search(spark.read.parquet(path), ["all", "few"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(kw, [all,few])]" in text


def test_indexes_merge_and_empty_ones_work(spark, index_rows):
    rows, tiles = index_rows
    parts = [bitmaps.build_bitmaps(rows.where(f"pmod(col, 2) = {i}")) for i in (0, 1)]
    merged = bitmaps.merge_bitmaps(parts[0].unionByName(parts[1]))
    assert set(map(tuple, merged.collect())) == set(map(tuple, bitmaps.build_bitmaps(rows).collect()))
    none = bitmaps.build_bitmaps(rows.limit(0))
    assert bitmaps.and_search(none, ["all"]).count() == bitmaps.or_search(none, ["all"]).count() == 0
    with pytest.raises(ValueError):
        bitmaps.and_search(none, ["all"], "sometimes")
    with pytest.raises(ValueError):
        bitmaps.or_search(none, [])


def test_far_positions_of_the_curve(spark):
    far = [0, 1, 7, 8, 32767, 32768, 65535, (1 << 61) + 5]
    rows = spark.createDataFrame([("k", "d", x) for x in far], "kw string, dataset_uid string, sfc long")
    assert sorted(r.sfc for r in bitmaps.positions(bitmaps.build_bitmaps(rows)).collect()) == far
