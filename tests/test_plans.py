"""Plans: no nested loops, filters and columns reach the scan."""

import re

import pytest
from conftest import SF_SMALL
from test_sources import stored_tiles

from tilequarry.catalog.queries import QUERIES
from tilequarry.operators import coverage as cov

SLOW = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_all_with_all(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    assert not any(s in text for s in SLOW), name
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text


def test_without_broadcast_joins_stay_equi_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("tile_feature_join", "search_then_query", "mask_region", "feature_feature_join", "tiles_in_extent"):
            df = QUERIES[name](spark, SF_SMALL)
            text = plan(df)
            assert not any(s in text for s in SLOW) and "SortMergeJoin" in text, name
            df.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_extent_filter_reaches_the_files_and_metadata_reads_no_band(spark, tmp_path):
    tiles = stored_tiles(spark, str(tmp_path / "tiles"))
    found = cov.tiles_in_extent(tiles, 10.0, -30.0, 20.0, -10.0).select("dataset_uid", "col", "row_")
    text = plan(found)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    for f in ("LessThan(xmin,20.0)", "GreaterThan(xmax,10.0)", "LessThan(ymin,-10.0)", "GreaterThan(ymax,-30.0)"):
        assert f in pushed
    assert "bands" not in re.search(r"ReadSchema: (\S+)", text).group(1)
    assert found.count() == 2 * 3


def test_footprints_read_keys_only(spark):
    text = plan(QUERIES["scan_tiles"](spark, SF_SMALL))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint>", text)
