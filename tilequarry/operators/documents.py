"""Tile metadata documents: what the features on a tile say about it.

A document is a header line ``{"tile_file_name", "tile_code",
"tile_dataset_uid"}`` and one line of attributes per feature, in fid order; a
tile without features has one empty object.  Lines end in ",\n" as separators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import REGION_SIZE
from tilequarry.functions import scalars
from tilequarry.operators import coverage as cov
from tilequarry.operators.layout import TILE_KEY
from tilequarry.session import kept

TILE_NAMES = [*TILE_KEY, "tile_code", "file_name"]


def tile_attributes(tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE) -> DataFrame:
    """One row per tile and intersecting feature, with the feature's attributes."""
    return with_attributes(cov.tile_features(tiles, features, region_size), features)


def with_attributes(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs with the attributes of their feature; a table of ids and attributes alone will do."""
    checked = [c for c in ("rings",) if c in features.columns]
    return pairs.join(cov.once(features.select("fid", *checked, "attrs")).select("fid", "attrs"), "fid")


def tile_documents(tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE,
                   part_features: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(dataset_uid, col, row_, tile_code, file_name, doc_path, part, n_features, doc).

    Left outer: every tile has a document, one row of part 0 in fid order whatever the
    number of features.  Only with ``part_features`` is a fuller tile written in parts of
    about so many features, each with the header; the pairs are then used twice.  Give
    ``pairs`` to read them from a stored table.
    """
    if pairs is None:
        pairs = cov.tile_features(tiles, features, region_size)
    pairs = pairs.select(*TILE_KEY, "fid")
    on_tile, part = with_attributes(pairs, features), F.lit(0)
    if part_features is not None:
        sizes = pairs.groupBy(*TILE_KEY).agg(F.count("*").alias("n")).where(F.col("n") > part_features)
        on_tile = on_tile.join(sizes, TILE_KEY, "left")
        part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("fid"), F.ceil(F.col("n") / part_features)))
    parted = on_tile.select(*TILE_KEY, "fid", F.to_json("attrs").alias("line"), part.alias("part"))
    bodies = parted.groupBy(*TILE_KEY, "part").agg(
        F.count("*").alias("n_features"),
        F.sort_array(F.collect_list(F.struct("fid", "line"))).alias("lines"),
    ).select(*TILE_KEY, "part", "n_features", F.array_join(F.col("lines.line"), ",\n").alias("body"))
    header = F.to_json(F.struct(
        F.col("file_name").alias("tile_file_name"), F.col("tile_code"),
        F.col("dataset_uid").alias("tile_dataset_uid")))
    return tiles.select(*TILE_NAMES).join(bodies, TILE_KEY, "left").select(
        *TILE_NAMES,
        scalars.path_join("json", scalars.doc_name(F.col("file_name"))).alias("doc_path"),
        F.coalesce("part", F.lit(0)).cast("int").alias("part"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
        F.concat(header, F.lit(",\n"), F.coalesce("body", F.lit("{}"))).alias("doc"),
    )


def document_lines(tiles: DataFrame, features: DataFrame, region_size: float | None = REGION_SIZE,
                   pairs: DataFrame | None = None) -> DataFrame:
    """(dataset_uid, doc_path, place, fid, line): the same documents, a row for each of their lines.

    Lines come by (place, fid): the header, then features, or the empty object.  No row holds a document, so a
    tile may carry any number of features.  Pairs that are not given are stored first, as they are used twice.
    """
    if pairs is None:
        pairs = kept(cov.tile_features(tiles, features, region_size).select(*TILE_KEY, "fid"), "pairs")
    pairs = pairs.select(*TILE_KEY, "fid")
    last = pairs.groupBy(*TILE_KEY).agg(F.max("fid").alias("last"))
    named = tiles.select(*TILE_NAMES, scalars.path_join("json", scalars.doc_name(F.col("file_name"))).alias("doc_path")).join(
        last, TILE_KEY, "left")
    header = F.to_json(F.struct(
        F.col("file_name").alias("tile_file_name"), F.col("tile_code"), F.col("dataset_uid").alias("tile_dataset_uid")))
    none = F.lit(None).cast("long")
    first = F.struct(F.lit(0).alias("place"), none.alias("fid"), F.concat(header, F.lit(",")).alias("line"))
    empty = F.struct(F.lit(1).alias("place"), none.alias("fid"), F.lit("{}").alias("line"))
    heads = named.select("dataset_uid", "doc_path", F.inline(F.when(F.col("last").isNull(), F.array(first, empty)).otherwise(F.array(first))))
    after = F.when(F.col("fid") == F.col("last"), "").otherwise(",")
    body = with_attributes(pairs, features).join(named.select(*TILE_KEY, "doc_path", "last"), TILE_KEY).select(
        "dataset_uid", "doc_path", F.lit(1).alias("place"), F.col("fid").cast("long").alias("fid"),
        F.concat(F.to_json("attrs"), after).alias("line"))
    return heads.unionByName(body)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rows (doc_path, tile_code, dataset_uid, attrs) of document lines, one for each feature.

    ``lines`` has dataset_uid, doc_path and line, in any order.  The line with exactly the three keys of a header is one.
    """
    attrs = F.from_json(F.regexp_replace("line", ",$", ""), "map<string,string>")
    parsed = lines.select("doc_path", "dataset_uid", attrs.alias("attrs")).where(F.size("attrs") > 0)
    header = F.array_sort(F.map_keys("attrs")) == F.array(*[F.lit(k) for k in ("tile_code", "tile_dataset_uid", "tile_file_name")])
    code = scalars.parse_tile_name(F.regexp_replace("doc_path", r"\.json$", ".tif"))["tile_code"]
    return parsed.where(~header).select("doc_path", code.alias("tile_code"), "dataset_uid", "attrs")


def parse_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_path, tile_code, dataset_uid, attrs) of document texts, one per feature line.

    ``docs`` has doc_path and doc.  The empty object of a tile without features
    gives no row.
    """
    lines = docs.select("doc_path", F.split("doc", ",?\n").alias("lines"))
    header = F.from_json(F.element_at("lines", 1), "tile_file_name STRING, tile_code STRING, tile_dataset_uid STRING")
    rows = lines.select(
        "doc_path", header.alias("h"), F.explode(F.slice("lines", F.lit(2), F.size("lines") - 1)).alias("line"))
    parsed = rows.select(
        "doc_path", F.col("h.tile_file_name").alias("file_name"), "h.tile_code",
        F.col("h.tile_dataset_uid").alias("dataset_uid"),
        F.from_json("line", "map<string,string>").alias("attrs"))
    return parsed.where(F.size("attrs") > 0)
