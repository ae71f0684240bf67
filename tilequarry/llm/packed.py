"""Compact rows for hashes of places in texts: one row for each bucket and few megabytes of text.

A row has the documents that occur (id and text hash), how many places each has, the
places as gaps, and the hashes.  Numbers that are mostly small take one byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Hashes or, where h1 is empty, places already known to be wanted.
PACKED = "bucket long, oid binary, tk binary, n binary, pos binary, h1 binary, h2 binary"
COLUMNS = ["bucket", "oid", "tk", "n", "pos", "h1", "h2"]
#: Places on their way to the documents: `part` is a function of the document.
PLACES = "part long, oid binary, tk binary, n binary, pos binary"
#: One row per document: its places, ascending, as little-endian u32.
DOCUMENT = "oid long, tk long, pos binary"
_U = np.uint64


def squeeze(x: np.ndarray) -> bytes:
    """Numbers of 0 or more in one byte each; 255 means that it and the next byte add up."""
    if not len(x):
        return b""
    ends = np.cumsum(x // 255 + 1)
    out = np.full(ends[-1], 255, np.uint8)
    out[ends - 1] = x % 255
    return out.tobytes()


def running(packed: bytes) -> np.ndarray:
    """Running totals of the numbers that squeeze() packed."""
    b = np.frombuffer(packed, np.uint8)
    return np.cumsum(b, dtype=np.int64)[np.flatnonzero(b < 255)]


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal rows."""
    n = len(keys[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def row(key: int, oid: np.ndarray, tk: np.ndarray, doc: np.ndarray, pos: np.ndarray, *hashes: np.ndarray) -> tuple:
    """Entries in order of (doc, pos) as one row; oid and tk are looked up by doc."""
    first, n = runs(doc)
    gap = pos.copy()
    gap[1:] -= pos[:-1]
    gap[first] = pos[first]
    docs = doc[first]
    return (key, oid[docs].tobytes(), tk[docs].tobytes(), squeeze(n), squeeze(gap), *(h.tobytes() for h in hashes))


def rows(keys: np.ndarray, oid, tk, doc, pos, *hashes) -> list[tuple]:
    """One row for each key; entries come in order of (doc, pos)."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    first, _ = runs(keys[order])
    return [row(int(keys[part[0]]), oid, tk, doc[part], pos[part], *(h[part] for h in hashes))
            for part in np.split(order, first[1:])]


def joined(parts, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in parts] or [np.empty(0, kind)])


class Entries:
    """All entries of some rows, unpacked."""

    def __init__(self, frame: pd.DataFrame):
        self.oids, self.tks = joined(frame["oid"], np.int64), joined(frame["tk"], np.int64)
        doc, pos, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        for n, gap in zip(frame["n"], frame["pos"]):
            ends, total = running(n), running(gap)
            sizes = np.diff(ends, prepend=0)
            base = np.where(ends > sizes, total[ends - sizes - 1], 0)
            doc.append(np.repeat(np.arange(at, at + len(sizes), dtype=np.int32), sizes))
            pos.append(total - np.repeat(base, sizes))
            at += len(sizes)
        self.doc, self.pos = np.concatenate(doc), np.concatenate(pos).astype(np.int64)

    def places(self, at: np.ndarray, parts: int) -> pd.DataFrame:
        """These entries (ascending) as rows for their documents."""
        doc, pos = self.doc[at], self.pos[at]
        mixed = self.oids.view(np.uint64) * _U(0x9E3779B97F4A7C15) ^ self.tks.view(np.uint64)
        keys = ((mixed >> _U(16)) % _U(parts)).astype(np.int64)
        return pd.DataFrame(rows(keys[doc], self.oids, self.tks, doc, pos), columns=["part", "oid", "tk", "n", "pos"])


def known(frame: pd.DataFrame) -> pd.Series:
    return frame["h1"].str.len() == 0


def _documents(frame: pd.DataFrame) -> pd.DataFrame:
    e = Entries(frame)
    oid, tk = e.oids[e.doc], e.tks[e.doc]
    order = np.lexsort((e.pos, tk, oid))
    oid, tk, pos = oid[order], tk[order], e.pos[order]
    new = np.ones(len(pos), bool)
    new[1:] = (oid[1:] != oid[:-1]) | (tk[1:] != tk[:-1]) | (pos[1:] != pos[:-1])
    oid, tk, pos = oid[new], tk[new], pos[new]
    first, n = runs(oid, tk)
    raw = pos.astype("<u4").tobytes()
    return pd.DataFrame({"oid": oid[first], "tk": tk[first],
                         "pos": [raw[4 * a:4 * (a + k)] for a, k in zip(first.tolist(), n.tolist())]})


def by_document(places: DataFrame, name: str) -> DataFrame:
    """oid, tk and, named `name`, all places of each document."""
    return places.groupBy("part").applyInPandas(lambda frame: _documents(frame), DOCUMENT).withColumnRenamed("pos", name)
