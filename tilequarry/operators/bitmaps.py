"""Postings as bitmaps: for each keyword and block of the curve, a bit for every position.

The form beside the rows of ``index``: a keyword that is on every tile of a dataset is one row of 4 KB for each
32,768 tiles, a search reads one row for each of its keywords and each block, and AND and OR are aggregates over
those.  Positions without a tile have no bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import SFC_HILBERT
from tilequarry.functions import sfc
from tilequarry.operators.layout import TILE_KEY
from tilequarry.operators.search import _unique

#: Positions of the curve in a block: what Spark's bitmap functions hold.
BLOCK = 32_768
BLOCK_KEY = ["dataset_uid", "block"]


def build_bitmaps(postings: DataFrame) -> DataFrame:
    """(kw, dataset_uid, block, bitmap) of postings (kw, dataset_uid, sfc); repeated postings set a bit once."""
    at = F.col("sfc") + 1
    placed = postings.where("kw IS NOT NULL AND sfc >= 0").select(
        "kw", "dataset_uid", F.bitmap_bucket_number(at).alias("block"), F.bitmap_bit_position(at).alias("bit"))
    return placed.groupBy("kw", *BLOCK_KEY).agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One row for each keyword and block of several indexes put together."""
    return bitmaps.groupBy("kw", *BLOCK_KEY).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def and_search(bitmaps: DataFrame, keywords: list[str], mode: str = "strict") -> DataFrame:
    """(dataset_uid, block, bitmap) of the tiles that carry all keywords.

    A keyword that is nowhere in the index makes the answer empty (``strict``) or is ignored (``lenient``).
    """
    unique = _unique(keywords)
    asked = bitmaps.where(F.col("kw").isin(unique))
    if mode == "strict":
        wanted = F.lit(len(unique))
    elif mode == "lenient":
        wanted = asked.agg(F.count_distinct("kw")).scalar()
    else:
        raise ValueError(f"unknown mode {mode!r}; use 'strict' or 'lenient'")
    met = asked.groupBy(*BLOCK_KEY).agg(F.count("*").alias("n"), F.bitmap_and_agg("bitmap").alias("bitmap"))
    return met.where((F.col("n") == wanted) & (F.bitmap_count("bitmap") > 0)).select(*BLOCK_KEY, "bitmap")


def or_search(bitmaps: DataFrame, keywords: list[str]) -> DataFrame:
    """(dataset_uid, block, bitmap) of the tiles that carry any of the keywords."""
    asked = bitmaps.where(F.col("kw").isin(_unique(keywords)))
    return asked.groupBy(*BLOCK_KEY).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def tile_counts(bitmaps: DataFrame) -> DataFrame:
    """(kw, n_tiles): on how many tiles each keyword is, without unpacking a bitmap."""
    return bitmaps.groupBy("kw").agg(F.sum(F.bitmap_count("bitmap")).alias("n_tiles"))


def positions(found: DataFrame) -> DataFrame:
    """(dataset_uid, sfc) of every bit that is set; bytes without one are passed over."""
    byte = "cast(conv(hex(substring(bitmap, i + 1, 1)), 16, 10) AS int)"
    bits = f"""flatten(transform(filter(sequence(0, {BLOCK // 8 - 1}), i -> substring(bitmap, i + 1, 1) <> X'00'),
        i -> transform(filter(sequence(0, 7), b -> (shiftright({byte}, b) & 1) = 1), b -> i * 8 + b)))"""
    return found.selectExpr("dataset_uid", "block", f"explode({bits}) AS bit").selectExpr(
        "dataset_uid", f"(block - 1) * {BLOCK} + bit AS sfc")


def tiles_found(found: DataFrame, sizes: DataFrame, curve: str = SFC_HILBERT) -> DataFrame:
    """Tile keys of a search's bitmaps; ``sizes`` has the bits of each dataset's curve."""
    coded = positions(found).join(sizes.select("dataset_uid", "bits"), "dataset_uid")
    at = coded.withColumn("at", sfc.sfc_decode(curve, F.col("sfc"), F.col("bits")))
    return at.select("dataset_uid", F.col("at.col").cast("int").alias("col"), F.col("at.row").cast("int").alias("row_")).select(*TILE_KEY)
