"""Every registered query against its SQL, on the smallest tables; some on the next size."""

import duckdb
import pytest
from conftest import SF, SF_SMALL

import __spark_entry__ as entry
from tilequarry.catalog.oracle import ORACLE
from tilequarry.catalog.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
LARGER = ["tile_feature_join", "search_then_query", "mask_region", "tile_metadata_docs", "features_intersect_region"]


def compare(spark, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[cols.index(c)] for c in order) for r in want), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_small(spark, name):
    compare(spark, name, SF_SMALL)


@pytest.mark.parametrize("name", LARGER)
def test_larger(spark, name):
    compare(spark, name, SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 738
