"""Searching the index: keyword AND, tag values, and fetching the tiles found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.operators.layout import TILE_KEY

# The operators of a search tag.
OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "contains")
BITS = 62  # tests per bit word


@dataclass(frozen=True)
class SearchTag:
    """``tag operator value``, such as ``acctbal >= 100``."""

    tag: str
    op: str
    value: str


def parse_tags(words: list[str]) -> list[SearchTag]:
    """Tags from a flat list of triples."""
    if not words or len(words) % 3:
        raise ValueError("search tags come in threes: tag, operator, value")
    tags = [SearchTag(*words[i:i + 3]) for i in range(0, len(words), 3)]
    for t in tags:
        if t.op not in OPERATORS:
            raise ValueError(f"unknown operator {t.op!r}; use one of {OPERATORS}")
    return tags


def _words(tests: list[Column]) -> list[Column]:
    """Bit words: a bit for each test that holds, as many words as it takes."""
    out = []
    for a in range(0, len(tests), BITS):
        bits = F.lit(0).cast("bigint")
        for i, test in enumerate(tests[a:a + BITS]):
            bits = bits.bitwiseOR(F.when(test, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        out.append(bits.alias(f"bits_{a // BITS}"))
    return out


def _full(n: int) -> list[int]:
    """The bit words with all n bits set."""
    return [(1 << min(BITS, n - a)) - 1 for a in range(0, n, BITS)]


def _all_set(names: list[str], full: list) -> Column:
    hit = F.lit(True)
    for name, bits in zip(names, full):
        hit = hit & (F.col(name) == bits)
    return hit


def _unique(keywords: list[str]) -> list[str]:
    unique = list(dict.fromkeys(keywords))
    if not unique:
        raise ValueError("no keyword given")
    return unique


def search_all(postings: DataFrame, keywords: list[str], mode: str = "strict",
               keys: list[str] | None = None) -> DataFrame:
    """Tiles that carry all keywords.

    Each posting is one bit, or-ed per tile: a single aggregation with partial
    sums, whatever the number of keywords or the length of their lists.  A keyword
    that is nowhere in the index makes the answer empty (``strict``) or is ignored
    (``lenient``).
    """
    keys = keys or TILE_KEY
    unique = _unique(keywords)
    full = _full(len(unique))
    names = [f"bits_{k}" for k in range(len(full))]
    marked = postings.where(F.col("kw").isin(unique)).select(*keys, *_words([F.col("kw") == k for k in unique]))
    per_tile = marked.groupBy(*keys).agg(*[F.bit_or(b).alias(b) for b in names])
    if mode == "strict":
        return per_tile.where(_all_set(names, full)).select(*keys)
    if mode == "lenient":
        present = [marked.agg(F.bit_or(b).alias("present")).scalar() for b in names]
        return per_tile.where(_all_set(names, present)).select(*keys)
    raise ValueError(f"unknown mode {mode!r}; use 'strict' or 'lenient'")


def search_all_by_sets(postings: DataFrame, keywords: list[str], keys: list[str] | None = None) -> DataFrame:
    """The same answer as the strict search, as an INTERSECT of one set per keyword."""
    keys = keys or TILE_KEY
    sets = [postings.where(F.col("kw") == k).select(*keys) for k in _unique(keywords)]
    found = sets[0].distinct()
    for s in sets[1:]:
        found = found.intersect(s)
    return found


def _holds(tag: SearchTag, value: Column) -> Column:
    """The tag's test on an attribute value: numeric if both sides are numbers, else as text."""
    try:
        number = float(tag.value)
    except ValueError:
        number = None
    text = F.lit(tag.value)
    if tag.op == "contains":
        return F.contains(value, text)

    def compare(a: Column, b: Column) -> Column:
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tag.op]

    if number is None:
        return compare(value, text)
    numeric = value.try_cast("double")
    return F.when(numeric.isNotNull(), compare(numeric, F.lit(number))).otherwise(compare(value, text))


def search_values(tile_attrs: DataFrame, tags: list[SearchTag], keys: list[str] | None = None) -> DataFrame:
    """Tiles on which every tag holds for some feature.

    Each feature row yields a bit per tag that holds, or-ed per tile.
    """
    keys = keys or TILE_KEY
    if not tags:
        raise ValueError("no tag given")
    full = _full(len(tags))
    names = [f"bits_{k}" for k in range(len(full))]
    marked = tile_attrs.select(*keys, *_words([_holds(t, F.try_element_at("attrs", F.lit(t.tag))) for t in tags]))
    some = F.lit(False)
    for b in names:
        some = some | (F.col(b) != 0)
    per_tile = marked.where(some).groupBy(*keys).agg(*[F.bit_or(b).alias(b) for b in names])
    return per_tile.where(_all_set(names, full)).select(*keys)


def fetch_tiles(tiles: DataFrame, hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Only the tiles (or cells) that the search named."""
    return tiles.join(hits, keys or TILE_KEY, "left_semi")
