"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut as the vocabulary's library cuts it: special strings first, each one token,
then the pre-tokenizer's pieces.  The bytes of a piece are nodes of a linked list; a heap
holds every adjacent pair that has a merge rule, lowest rank first and leftmost among
equals.  Popping a pair that still stands joins its two nodes and offers the two new
neighbour pairs.  The count is bytes minus merges; no identifier leaves the operator.  The work is
n log n in the longest piece, so an unsplit run of any length needs no special case.

Each distinct piece is counted once per worker (up to REMEMBERED of them).  Only texts enter a task and
only counts leave it; nothing is shuffled.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row, repeated ones and
those without an id included, gets its own count; an empty table gives an empty one; all input columns are
carried in `doc`, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.llm.bpe import vocabulary
from tilequarry.llm.common import row_struct
from tilequarry.llm.tokens import byte_characters

#: Pieces remembered by one worker, and the longest that is.
REMEMBERED, LONGEST = 400_000, 64
#: Bits of a heap entry that hold the place of a pair, and of a pair that hold its right symbol.
_PLACE, _SYMBOL = 40, 32
_PLACES = (1 << _PLACE) - 1


class PieceCounts(dict):
    """Piece -> number of tokens, worked out when first asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = {c: k for k, c in enumerate(byte_characters())}
        #: Symbol numbers of a pair, in one number -> rank; rank -> number of the joined symbol.
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, rule in enumerate(model["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            self.joined.append(symbols.setdefault(left + right, len(symbols)))
            self.ranks.setdefault(symbols[left] << _SYMBOL | symbols[right], rank)
        self.cutter = vocabulary(path)
        self.update(dict.fromkeys(self.cutter.added, 1))

    def merge(self, piece: bytes) -> int:
        """Tokens of bytes that the pre-tokenizer does not split."""
        rank_of, joined, symbol, n = self.ranks.get, self.joined, list(piece), len(piece)
        heap = [r << _PLACE | k for k, (x, y) in enumerate(zip(symbol, piece[1:])) if (r := rank_of(x << _SYMBOL | y)) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens = n
        while heap:
            entry = heappop(heap)
            a = entry & _PLACES
            b = after[a]
            # A pair one of whose nodes was joined to another meanwhile has another rank, or none.
            if b == n or symbol[a] < 0 or rank_of(symbol[a] << _SYMBOL | symbol[b]) != entry >> _PLACE:
                continue
            symbol[a] = here = joined[entry >> _PLACE]
            symbol[b] = -1
            after[a] = c = after[b]
            tokens -= 1
            if c < n:
                before[c] = a
                if (r := rank_of(here << _SYMBOL | symbol[c])) is not None:
                    heappush(heap, r << _PLACE | a)
            z = before[a]
            if z >= 0 and (r := rank_of(symbol[z] << _SYMBOL | here)) is not None:
                heappush(heap, r << _PLACE | z)
        return tokens

    def __missing__(self, piece: str) -> int:
        found = self.merge(piece.encode())
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.cutter.added, 1))
            self[piece] = found
        return found

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, self.cutter.cut(text)))


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a text column, as long."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = piece_counts(path)
        for texts in batches:
            yield pd.Series([counts.of(t) for t in texts], dtype="int64")

    return count(F.coalesce(text.cast("string"), F.lit("")))


def count(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """doc (all input columns), n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    rows = docs.select(row_struct(docs), F.coalesce(F.octet_length(docs[text].cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                       token_count(docs[text], path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
