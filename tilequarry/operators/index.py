"""The inverted index: attribute keyword -> tiles.

Postings are kept one per row.  Some keywords are on every feature, so a
keyword's full list grows with the data; it is only ever gathered in blocks of
neighbouring curve positions, whose size is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.constants import POSTINGS_BLOCK_BITS
from tilequarry.functions import scalars
from tilequarry.operators.layout import TILE_KEY


def build_postings(tile_attrs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct (kw, tile) from rows that carry ``attrs`` per tile.

    The distinct is combined on the map side, so what is shuffled is bounded by
    keywords times tiles per task, however many features share them.
    """
    keys = keys or TILE_KEY
    return tile_attrs.select(F.explode(F.map_keys("attrs")).alias("kw"), *keys).distinct()


def postings_from_documents(parsed: DataFrame) -> DataFrame:
    """Postings of parsed document texts: (kw, doc_path, tile_code, dataset_uid)."""
    return build_postings(parsed, ["doc_path", "tile_code", "dataset_uid"])


def posting_counts(words: DataFrame) -> DataFrame:
    """How often each keyword occurs in each document; ``words`` has kw and doc."""
    return words.groupBy("kw", "doc").agg(F.count("*").alias("n"))


def text_words(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Lower-case words of a text column, split at everything that is no letter."""
    words = F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("kw")
    return docs.select(F.col(doc).alias("doc"), words).where("kw <> ''")


def render_text(postings: DataFrame, block_bits: int = POSTINGS_BLOCK_BITS) -> DataFrame:
    """Text form, ``(kw,(path,code,uid), (path,code,uid))``.

    ``postings`` has kw, doc_path, tile_code, dataset_uid.  A line covers one
    keyword, dataset and block of the curve; the reader joins lines of the same
    keyword again.
    """
    block = F.shiftright(F.conv("tile_code", 16, 10).cast("bigint"), block_bits)
    entry = F.concat(F.lit("("), F.concat_ws(",", "doc_path", "tile_code", "dataset_uid"), F.lit(")"))
    lists = postings.select("kw", "dataset_uid", block.alias("block"), entry.alias("entry")).groupBy(
        "kw", "dataset_uid", "block").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    line = F.concat(F.lit("("), F.col("kw"), F.lit(","), F.array_join("entries", ", "), F.lit(")"))
    return lists.select("kw", "dataset_uid", "block", F.size("entries").cast("bigint").alias("n"), line.alias("line"))


def load_text(lines: DataFrame) -> DataFrame:
    """Postings of text lines (column ``line``): (kw, doc_path, tile_code, dataset_uid)."""
    split = lines.select(
        F.regexp_extract("line", r"^\(([^,]*),(.*)\)$", 1).alias("kw"),
        F.regexp_extract("line", r"^\(([^,]*),(.*)\)$", 2).alias("list"))
    entries = split.select("kw", F.explode(F.regexp_extract_all("list", F.lit(r"\(([^)]*)\)"), 1)).alias("entry"))
    part = F.split("entry", r"\s*,\s*")
    return entries.select(
        "kw", part[0].alias("doc_path"), part[1].alias("tile_code"), part[2].alias("dataset_uid"))


def json_keywords(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(kw, doc) for every top-level key of a JSON column."""
    return docs.select(F.explode(scalars.json_keys(F.col(text))).alias("kw"), F.col(doc).alias("doc"))
