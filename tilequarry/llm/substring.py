"""Substring dedup over words with fixed-block anchors.

A window of W words holds a whole aligned block of B = (W + 1) // 2 words, wherever it
starts.  So of two equal windows, the block aligned in one is a rolling B-word window of the
other: every text's non-overlapping blocks are indexed, every rolling window probes them, and
around each hit, on either side, the W-word windows that hold it are looked at: equal
ones are put in order, all but the first are marked, and runs of marked windows are the
maximal repeats that go.

How the work is dealt: the probes of a few megabytes of text leave a task as one compact row per
bucket (32-bit fingerprints and gap-coded positions), each distinct value once, so a
passage in a third of all texts reaches a bucket once per few megabytes.  The number of
buckets follows the bytes of text, so a bucket stays small at any size.  Window identity is
96 hash bits beside the bucket; no window is compared pair by pair.

Order is (doc_id, start); a window goes if an equal one has a smaller such pair.  Defined results: null doc_id
counts as the smallest; null, empty and blank texts have no words; rows with the same
doc_id and text are judged alike and never remove each other at the same start;
an empty table gives an empty result; all input columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import packed, wordhash
from tilequarry.llm.common import released, row_struct
from tilequarry.llm.tokens import slices

WINDOW = 20
#: Bytes of text for each bucket of probes.
BUCKET_BYTES = 24 << 20
_U = np.uint64


class _Slice:
    """The words of some texts and where each lies."""

    def __init__(self, texts: list[bytes], oid: np.ndarray, tk: np.ndarray):
        self.hashes, self.counts = wordhash.words(texts)
        self.oid, self.tk = oid, tk
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        return np.flatnonzero(wordhash.inside(self.counts, size))

    def pos(self, at: np.ndarray) -> np.ndarray:
        return at - self.first[self.doc[at]]

    def rows(self, buckets, at, *hashes) -> list[tuple]:
        return packed.rows(buckets, self.oid, self.tk, self.doc[at], self.pos(at), *hashes)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[_Slice, pd.DataFrame]]:
    for b in batches:
        texts = b["text"].tolist()
        for i, j in slices(texts):
            part = b.iloc[i:j]
            yield _Slice(texts[i:j], part["oid"].to_numpy(np.int64), part["tk"].to_numpy(np.int64)), part


@released
def _probes(batches: Iterator[pd.DataFrame], block: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Index blocks and probes, packed by bucket; windows that repeat right here are hits already (rows without hashes)."""
    for s, _ in _slices(batches):
        at = s.windows(block)
        h = wordhash.rolling(s.hashes, block)[at]
        aligned = s.pos(at) % block == 0
        deal = np.concatenate((np.flatnonzero(aligned), np.flatnonzero(~aligned)))  # blocks stand first among equals
        order = deal[np.argsort(h[deal], kind="stable")]
        first, n = packed.runs(h[order])
        repeated = np.sort(order[np.repeat(n > 1, n)])
        sent = np.sort(order[first])
        low = (h[sent] & _U(0xFFFFFFFF)).astype(np.uint32)
        rows = [(*r, b"") for r in s.rows((h[sent] >> _U(32)) % _U(buckets), at[sent], low)]
        if len(repeated):
            rows.append((*packed.row(int(h[repeated[0]] % _U(buckets)), s.oid, s.tk, s.doc[at[repeated]], s.pos(at[repeated])), b"", b""))
        yield pd.DataFrame(rows, columns=packed.COLUMNS)


def _hits(frame: pd.DataFrame, block: int, parts: int) -> pd.DataFrame:
    """Blocks and windows of one bucket that found each other, and the hits found earlier."""
    here = packed.known(frame)
    old, e = packed.Entries(frame[here]), packed.Entries(frame[~here])
    out = [old.places(np.arange(len(old.pos)), parts)]
    order = np.argsort(fp := packed.joined(frame["h1"][~here], np.uint32))
    first, n = packed.runs(fp[order])
    if len(first):
        found = (n > 1) & np.maximum.reduceat((e.pos % block == 0)[order], first)
        out.append(e.places(np.sort(order[np.repeat(found, n)]), parts))
    return pd.concat(out)


@released
def _candidates(batches: Iterator[pd.DataFrame], window: int, block: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Windows that hold a hit, by 96 bits of hash; those with an earlier equal right here are marked already."""
    for s, part in _slices(batches):
        total = int(s.counts.sum())
        edge = np.zeros(total + 1, np.int64)
        for k, hits in enumerate(part["hits"]):
            p = np.frombuffer(hits, "<u4").astype(np.int64)
            p = p[p < s.counts[k]] + s.first[k]
            np.add.at(edge, np.maximum(p - (window - block), s.first[k]), 1)
            np.subtract.at(edge, p + 1, 1)
        near = np.cumsum(edge)[:total] > 0
        at = s.windows(window)
        at = at[near[at]]
        h1, h2 = wordhash.rolling(s.hashes, window)[at], wordhash.rolling(s.hashes, window, second=True)[at].astype(np.uint32)
        oid, pos = s.oid[s.doc[at]], s.pos(at)
        later, firsts = _later(h1, h2, oid, pos)
        rows = s.rows(h1[firsts] % _U(buckets), at[firsts], h1[firsts], h2[firsts])
        if len(later):
            rows.append((*packed.row(int(h1[later[0]] % _U(buckets)), s.oid, s.tk, s.doc[at[later]], pos[later]), b"", b""))
        yield pd.DataFrame(rows, columns=packed.COLUMNS)


def _later(h1, h2, oid, pos) -> tuple[np.ndarray, np.ndarray]:
    """Entries with an equal window at a smaller (oid, pos), and a first one of each kind; both ascend."""
    order = np.argsort(h1, kind="stable")
    first, n = packed.runs(h1[order])
    alone, several = order[first[n == 1]], order[np.repeat(n > 1, n)]
    order = several[np.lexsort((pos[several], oid[several], h2[several], h1[several]))]
    first, n = packed.runs(h1[order], h2[order])
    least = np.repeat(order[first], n)
    later = (oid[order] > oid[least]) | (pos[order] > pos[least])
    return np.sort(order[later]), np.sort(np.concatenate((alone, order[first])))


def _repeats(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Starts of windows with an earlier equal."""
    here = packed.known(frame)
    old, e = packed.Entries(frame[here]), packed.Entries(frame[~here])
    h1, h2 = packed.joined(frame["h1"][~here], np.uint64), packed.joined(frame["h2"][~here], np.uint32)
    later, _ = _later(h1, h2, e.oids[e.doc], e.pos)
    return pd.concat([old.places(np.arange(len(old.pos)), parts), e.places(later, parts)])


def dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id",
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc (all input columns), n_words, n_removed, spans (start, end, start, end, ... in words), kept (UTF-8)."""
    block = (window + 1) // 2
    body = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    rows = docs.select(row_struct(docs), F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("oid"),
                       F.xxhash64(body).alias("tk"))
    body = F.coalesce(F.col("doc").getField(text).cast("binary"), F.lit(b""))
    # Two joins look at the whole rows; naming all of doc in both keeps their exchange the same, so it is done once.
    whole = F.xxhash64("doc").alias("whole")
    size = rows.agg(F.sum(F.octet_length(body))).first()[0] or 0
    buckets = int(size // bucket_bytes) + 1
    hits = packed.by_document(rows.select("oid", "tk", body.alias("text")).mapInPandas(
        partial(_probes, block=block, buckets=buckets), packed.PACKED).groupBy("bucket").applyInPandas(
        lambda frame: _hits(frame, block, buckets), packed.PLACES), "hits")
    found = rows.join(hits, ["oid", "tk"]).select("oid", "tk", body.alias("text"), "hits", whole)
    marks = packed.by_document(found.mapInPandas(
        partial(_candidates, window=window, block=block, buckets=buckets), packed.PACKED).groupBy("bucket").applyInPandas(
        lambda frame: _repeats(frame, buckets), packed.PLACES), "marks")

    @F.pandas_udf("n_words long, n_removed long, spans array<long>, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, marked, _ in batches:
            out = []
            for t, m in zip(texts, marked):
                w = t.split()
                if m is None:
                    out.append((len(w), 0, [], b" ".join(w)))
                    continue
                p = np.frombuffer(m, "<u4").astype(np.int64)
                edge = np.zeros(len(w) + 1, np.int64)
                edge[p] += 1
                edge[p + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = b" ".join([w[k] for k in np.flatnonzero(~gone).tolist()])
                out.append((len(w), int(gone.sum()), turn.tolist(), kept))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "kept"])

    return rows.join(marks, ["oid", "tk"], "left").select("doc", cut(body, "marks", whole).alias("r")).select("doc", "r.*")
