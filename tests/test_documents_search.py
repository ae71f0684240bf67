"""Documents, index and search, hot tiles and hot keywords included."""

import pytest
import shapes
from pyspark.sql import functions as F

from tilequarry.functions import scalars
from tilequarry.operators import documents, index, layout, search


@pytest.fixture(scope="module")
def world(spark):
    rows = shapes.tile_rows("d1", 0, 0, 8, 8, 4, 4)
    tiles = layout.with_tile_code(spark.createDataFrame(rows, shapes.TILE_SCHEMA))
    polygons = shapes.random_polygons(2, 30, 26, 5) + [
        (fid, [[(1.0, -1.0), (2.0, -1.0), (2.0, -2.0), (1.0, -1.0)]]) for fid in range(100, 400)]
    features = shapes.features_frame(
        spark, polygons, UID=str, area=lambda f: str(f * 1.5), **{"na,me": lambda f: 'q"uote'})
    pairs = {(r[1], r[2], fid) for r in rows for fid, rings in polygons if shapes.meets_box(rings, r[3:7])}
    return tiles, features, pairs


def test_documents_hold_every_feature_and_hot_tiles_come_in_parts(spark, world):
    tiles, features, pairs = world
    docs = documents.tile_documents(tiles, features, 16.0, part_features=40)
    rows = docs.collect()
    assert {(r.col, r.row_) for r in rows} == {(c, r) for c in range(4) for r in range(4)}
    assert sum(r.n_features for r in rows) == len(pairs)
    hot = [r for r in rows if (r.col, r.row_) == (0, 0)]
    assert len(hot) > 4 and max(r.n_features for r in hot) < 120
    parsed = documents.parse_documents(docs).join(tiles.select("tile_code", "col", "row_"), "tile_code")
    got = {(r.col, r.row_, int(r.attrs["UID"])) for r in parsed.collect()}
    assert got == pairs
    empty = [r for r in rows if r.n_features == 0]
    assert all(r.doc.endswith(",\n{}") for r in empty)


def test_index_from_documents_equals_index_from_the_join(spark, world):
    tiles, features, pairs = world
    docs = documents.tile_documents(tiles, features, 16.0)
    a = index.postings_from_documents(documents.parse_documents(docs)).select("kw", "tile_code").distinct()
    b = index.build_postings(documents.tile_attributes(tiles, features, 16.0), ["tile_code"])
    assert set(map(tuple, a.collect())) == set(map(tuple, b.collect()))
    assert {r.kw for r in b.collect()} == {"UID", "area", "na,me"}


def test_text_index_round_trip_in_blocks(spark, world):
    tiles, features, pairs = world
    attrs = documents.tile_attributes(tiles, features, 16.0).select(
        F.map_filter("attrs", lambda k, v: k != "na,me").alias("attrs"),
        F.concat(F.lit("json/"), "tile_code").alias("doc_path"), "tile_code", "dataset_uid")
    postings = index.build_postings(attrs, ["doc_path", "tile_code", "dataset_uid"])
    text = index.render_text(postings, block_bits=2)
    assert text.agg(F.max("n")).first()[0] <= 4
    assert set(map(tuple, index.load_text(text).collect())) == set(
        map(tuple, postings.select("kw", "doc_path", "tile_code", "dataset_uid").collect()))


def test_loads_the_plain_text_form(spark):
    lines = spark.createDataFrame([("(seg,(file:/a/1.json,00ff,u1), (file:/a/2.json,01ff,u1))",)], "line string")
    assert sorted(map(tuple, index.load_text(lines).collect())) == [
        ("seg", "file:/a/1.json", "00ff", "u1"), ("seg", "file:/a/2.json", "01ff", "u1")]


def test_keyword_modes(spark):
    rows = [("a", "d", 0, 0), ("b", "d", 0, 0), ("a", "d", 1, 0), ("a", "d", 1, 0), ("b", "d", 2, 0)]
    postings = spark.createDataFrame(rows, "kw string, dataset_uid string, col int, row_ int")

    def cols(df):
        return sorted(r.col for r in df.collect())

    assert cols(search.search_all(postings, ["a", "b"])) == [0]
    assert cols(search.search_all(postings, ["a", "b", "a"])) == [0]
    assert cols(search.search_all(postings, ["a", "zzz"])) == []
    assert cols(search.search_all(postings, ["a", "zzz"], mode="lenient")) == [0, 1]
    assert cols(search.search_all(postings, ["zzz"], mode="lenient")) == []
    assert cols(search.search_all(postings, ["A"])) == []
    assert cols(search.search_all_by_sets(postings, ["a", "b"])) == [0]
    for bad in (dict(keywords=[]), dict(keywords=["a"], mode="loose")):
        with pytest.raises(ValueError):
            search.search_all(postings, **bad)


def test_tags(spark):
    tags = search.parse_tags(["area", ">=", "10", "name", "contains", "ab"])
    assert tags[0] == search.SearchTag("area", ">=", "10")
    for bad in ([], ["a", "="], ["a", "~", "1"]):
        with pytest.raises(ValueError):
            search.parse_tags(bad)
    rows = [({"area": "12", "name": "xaby"}, 1), ({"area": "9"}, 2), ({"name": "ab"}, 2),
            ({"area": "10"}, 3), ({"name": "cab"}, 3), ({"area": "many", "name": "ab"}, 4)]
    attrs = spark.createDataFrame([(a, "d", c, 0) for a, c in rows],
                                  "attrs map<string,string>, dataset_uid string, col int, row_ int")
    assert sorted(r.col for r in search.search_values(attrs, tags).collect()) == [1, 3, 4]
    for op, want in (("=", [3]), ("!=", [1, 2, 4]), ("<", [2]), ("<=", [2, 3]), (">", [1, 4])):
        got = search.search_values(attrs, [search.SearchTag("area", op, "10")]).collect()
        assert sorted({r.col for r in got}) == want, op


def test_more_keywords_than_bits_of_a_word(spark):
    names = [f"k{i}" for i in range(150)]
    rows = [(k, "d", 0, 0) for k in names] + [(k, "d", 1, 0) for k in names[:-1]]
    postings = spark.createDataFrame(rows, "kw string, dataset_uid string, col int, row_ int")
    assert [r.col for r in search.search_all(postings, names).collect()] == [0]
    assert sorted(r.col for r in search.search_all(postings, names[:-1] + ["zzz"], mode="lenient").collect()) == [0, 1]
    attrs = spark.createDataFrame([({k: "1"}, "d", 0, 0) for k in names], "attrs map<string,string>, dataset_uid string, col int, row_ int")
    tags = [search.SearchTag(k, "=", "1") for k in names]
    assert search.search_values(attrs, tags).count() == 1
    assert search.search_values(attrs, [*tags, search.SearchTag("no", "=", "1")]).count() == 0


def test_only_the_json_folder_of_a_path_goes(spark):
    paths = spark.createDataFrame([("/data/jsonruns/tiles/json/a.json",), ("/x/json/json/b.json",)], "p string")
    got = [r.t for r in paths.select(scalars.doc_to_tile_path(paths.p).alias("t")).collect()]
    assert got == ["/data/jsonruns/tiles/a.tif", "/x/json/b.tif"]


def test_a_full_tile_is_one_document_in_fid_order(spark):
    tiles = layout.with_tile_code(spark.createDataFrame(shapes.tile_rows("d1", 0, 0, 8, 8, 1, 1), shapes.TILE_SCHEMA))
    n = 4500
    pairs = tiles.crossJoin(spark.range(n).withColumnRenamed("id", "fid")).select("dataset_uid", "col", "row_", "fid")
    features = spark.range(n).select(F.col("id").alias("fid"), F.create_map(F.lit("UID"), F.col("id").cast("string")).alias("attrs"))
    rows = documents.tile_documents(tiles, features, 16.0, pairs=pairs).collect()
    assert [(r.part, r.n_features) for r in rows] == [(0, n)]
    assert rows[0].doc.split(",\n")[1:] == ['{"UID":"%d"}' % k for k in range(n)]
