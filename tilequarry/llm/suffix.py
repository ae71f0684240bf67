"""Suffix-array dedup over bytes: every byte of an L-byte string that stands anywhere else too goes.

Sorting is two-stage: only suffixes smaller than their successors are sorted directly; one
scan over the first-byte buckets in order puts every other suffix in its place; then the
common prefixes of neighbours tell which L-byte strings repeat.

To sort in parts, equal strings must meet in one part.  Every L-byte window is assigned to its
anchor, the leftmost least K-byte hash in it, so equal windows have equal anchors.  A stretch
of windows with one anchor, and the bytes they span, is a piece.  Anchors seen once are gone
after a compact exchange (each value once per few megabytes of text); the pieces of the
others are dealt by anchor, equal ones collapse to one with a count, and each part's
different pieces are sorted as one text.  Pieces of an anchor with more than `hot_bytes` are cut by
the bytes common to `SEGMENTS` neighbouring windows and dealt again, down to single windows, which are
only counted.  Every piece takes part; nothing is sampled or capped.

Defined results: null and empty texts have no bytes; texts under L bytes are kept whole; each row is an
occurrence, so rows with the same text of L bytes or more lose it all, first row included; a null
doc_id is carried; an empty table gives an empty result; all input columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm import packed
from tilequarry.llm.common import released, row_struct, written
from tilequarry.llm.tokens import slices
from tilequarry.llm.wordhash import mix

LENGTH = 400
#: Bytes of an anchor.
ANCHOR = 32
#: Windows that stay together when a hot anchor's pieces are cut, level by level.
SEGMENTS = (32, 1)
#: Bytes of different pieces of one anchor that are sorted in one part, and bytes sorted as one text.
HOT_BYTES = 4 << 20
SORT_BYTES = 192 << 10
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 24 << 20
_AT_ONCE = 2 << 20  # bytes of text handled at a time
_HASHED = 512 << 10  # bytes of them hashed at a time, at some 100 bytes of memory each
_LONGEST = 512 << 10  # longer texts are handled in overlapping parts
_PIECES = "bucket long, key long, oid long, tk long, off long, n long, anchor long, body binary"
_U = np.uint64


# ---- sorting ------------------------------------------------------------------------

def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """All suffixes in the order of their first `depth` bytes at least."""
    n = len(text)
    t = np.frombuffer(text, np.uint8)
    if n < 2:
        return np.arange(n)
    # Type by run of equal bytes: smaller than its successor if the byte after the run is larger.
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.append(t[ends[:-1] + 1] > t[ends[:-1]], False)
    small = np.repeat(rises, np.diff(np.concatenate(([-1], ends))))
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: text[i:i + depth]), np.int64)
    first = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        # Larger suffixes of this bucket: put here by earlier buckets, then by one another along a run of c.
        large = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        chain, new = [large], large
        while len(new):
            new = new[new > 0] - 1
            new = new[(t[new] == c) & ~small[new]]
            chain.append(new)
        bucket = np.concatenate([*chain, direct[first[c]:first[c + 1]]])
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        before = before[np.argsort(t[before], kind="stable")]
        for part in np.split(before, np.flatnonzero(np.diff(t[before])) + 1) if len(before) else []:
            induced[t[part[0]]].append(part)
        out.append(bucket)
    return np.concatenate(out)


def neighbour_prefixes(text: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in `order` and the one before it, up to `depth`; 0 for the first."""
    words = np.lib.stride_tricks.as_strided(
        np.frombuffer(text + bytes(depth + 8), np.uint8), (len(text) + depth, 8), (1, 1)).copy().view("<u8").ravel()
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for off in range(0, depth, 8):
        differ = words[a[alive] + off] ^ words[b[alive] + off]
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + _U(1))  # lowest bit that differs
        out[alive[stop] + 1] = off + (np.bitwise_count(low - _U(1)).astype(np.int64) >> 3)
        alive = alive[~stop]
    out[alive + 1] = depth
    return np.minimum(out, depth)


def repeated(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its `length`-byte windows stand elsewhere among the bodies too."""
    text = b"\xff".join(bodies) + b"\xff"
    starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    window = np.zeros(len(text), bool)
    for s, b in zip(starts.tolist(), bodies):
        window[s:s + len(b) - length + 1] = True
    order = suffix_array(text, length)
    order = order[window[order]]
    same = neighbour_prefixes(text, order, length) >= length
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = np.zeros(len(text), bool)
    hit[order[twice]] = True
    return [hit[s:s + len(b) - length + 1] for s, b in zip(starts.tolist(), bodies)]


# ---- anchors ------------------------------------------------------------------------

_BYTE = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """text, first window, windows, anchor position and hash of each stretch with one anchor, in order."""
    found = []
    for a, b in slices(texts, _HASHED):
        text, *rest = _anchors(texts[a:b], length)
        found.append((text + a, *rest))
    return tuple(map(np.concatenate, zip(*found))) if found else _anchors([], length)


def _anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """anchors() of texts that are hashed at once."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(data)
    if n < length:
        return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.uint64))
    gram = min(ANCHOR, length)
    power = _powers(1 << max(21, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[0][:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * power[1][:n - gram + 1])
    # The leftmost of the least: 40 bits of hash, then the position.
    rank = (hashes & ~_U(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    wide = length - gram + 1
    rows = -(-len(rank) // wide)
    padded = np.full(rows * wide, ~_U(0))
    padded[:len(rank)] = rank
    grid = padded.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    at = (np.minimum(behind[:count], ahead[wide - 1:wide - 1 + count]) & _U(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:count]
    inside = np.flatnonzero(np.arange(count) + length <= ends[text])
    first, windows = packed.runs(text[inside], at[inside])
    start = inside[first]
    base = (ends - sizes)[text[start]]
    return text[start], start - base, windows, at[start] - base, hashes[at[start]]


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Row, offset and bytes of texts, a few megabytes at a time; a long text in parts whose windows do not overlap."""
    for i, j in slices(texts, _AT_ONCE):
        rows, offs, parts = [], [], []
        for k in range(i, j):
            for a in range(0, max(1, len(texts[k]) - length + 1), _LONGEST):
                rows.append(k)
                offs.append(a)
                parts.append(texts[k][a:a + _LONGEST + length - 1])
        for a, b in slices(parts, _AT_ONCE):
            yield rows[a:b], offs[a:b], parts[a:b]


def _stretches(batches: Iterator[pd.DataFrame], length: int):
    """For a few megabytes of text: ids of the texts, their parts, and the stretches in them."""
    for b in batches:
        texts = b["text"].tolist()
        oid, tk = b["oid"].to_numpy(np.int64), b["tk"].to_numpy(np.int64)
        for rows, offs, parts in _parts(texts, length):
            text, lo, n, at, h = anchors(parts, length)
            row, off = np.asarray(rows)[text], np.asarray(offs)[text]
            yield b, oid, tk, row, parts, text, lo, lo + off, n, at, h


@released
def _probes(batches: Iterator[pd.DataFrame], length: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Anchor hashes, packed by bucket; those that repeat right here are hits already (rows without hashes)."""
    for _, oid, tk, row, _, _, _, pos, _, _, h in _stretches(batches, length):
        order = np.argsort(h, kind="stable")
        first, n = packed.runs(h[order])
        many = np.sort(order[np.repeat(n > 1, n)])
        sent = np.sort(order[first])
        rows = [(*r, b"") for r in packed.rows(h[sent] % _U(buckets), oid, tk, row[sent], pos[sent], h[sent])]
        if len(many):
            rows.append((*packed.row(int(h[many[0]] % _U(buckets)), oid, tk, row[many], pos[many]), b"", b""))
        yield pd.DataFrame(rows, columns=packed.COLUMNS)


def _hits(frame: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Stretches whose anchor stands elsewhere too."""
    here = packed.known(frame)
    old, e = packed.Entries(frame[here]), packed.Entries(frame[~here])
    order = np.argsort(h := packed.joined(frame["h1"][~here], np.uint64))
    _, n = packed.runs(h[order])
    return pd.concat([old.places(np.arange(len(old.pos)), parts), e.places(np.sort(order[np.repeat(n > 1, n)]), parts)])


@released
def _pieces(batches: Iterator[pd.DataFrame], length: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Pieces to be sorted; equal ones that meet right here are marked (rows without body) and one goes on, with n = 0.

    A body says how many windows it has; n = 0 says that its own are marked already.
    """
    for b, oid, tk, row, parts, text, lo, pos, n, at, h in _stretches(batches, length):
        hits = {k: np.frombuffer(b["hits"].iat[k], "<u4") for k in np.unique(row).tolist()}
        wanted = np.zeros(len(row), bool)
        first, count = packed.runs(row)
        for a, c in zip(first.tolist(), count.tolist()):
            wanted[a:a + c] = np.isin(pos[a:a + c], hits[int(row[a])])
        seen: dict[tuple[int, bytes], list[int]] = {}
        for i in np.flatnonzero(wanted).tolist():
            body = parts[text[i]][lo[i]:lo[i] + n[i] + length - 1]
            seen.setdefault((int(h[i]), body), []).append(i)
        key = h.view(np.int64)
        out = []
        for (hash_, body), at_ in seen.items():
            i = at_[0]
            out.append((hash_ % buckets, key[i], oid[row[i]], tk[row[i]], pos[i], n[i] if len(at_) == 1 else 0, at[i] - lo[i], body))
            if len(at_) > 1:
                out += [(hash_ % buckets, key[j], oid[row[j]], tk[row[j]], pos[j], n[j], 0, None) for j in at_]
        yield pd.DataFrame(out, columns=["bucket", "key", "oid", "tk", "off", "n", "anchor", "body"])


@released
def _cut(batches: Iterator[pd.DataFrame], length: int, segment: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Pieces of hot anchors, cut so that each part's windows share all but `segment` - 1 bytes on either side."""
    for b in batches:
        out = []
        for key, oid, tk, off, n, anchor, body in b[["key", "oid", "tk", "off", "n", "anchor", "body"]].itertuples(index=False):
            windows = len(body) - length + 1
            for q in range((-anchor) // segment, (windows - 1 - anchor) // segment + 1):
                lo, hi = max(0, anchor + q * segment), min(windows, anchor + (q + 1) * segment)
                core = body[anchor + q * segment + segment - 1:anchor + q * segment + length]
                longer = xxhash.xxh64_intdigest(b"%d,%d," % (key, q) + core, segment)
                out.append((longer % buckets, longer - (1 << 64) * (longer >> 63), oid, tk, off + lo,
                            hi - lo if n else 0, anchor - lo, body[lo:hi + length - 1]))
        yield pd.DataFrame(out, columns=["bucket", "key", "oid", "tk", "off", "n", "anchor", "body"])


def _sorted(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """oid, tk, pos: ranges of window starts (u32 pairs) of the pieces of one bucket that stand elsewhere too."""
    oid, tk, off, n = (rows[c].to_numpy(np.int64) for c in ("oid", "tk", "off", "n"))
    body = rows["body"].tolist()
    out: list[tuple[int, bytes]] = []

    def sort(batch: dict[bytes, int]) -> None:
        for i, hit in zip(batch.values(), repeated(list(batch), length)):
            if i >= 0 and n[i] and hit.any():
                turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                out.append((i, (turn + off[i]).astype("<u4").tobytes()))

    batch: dict[bytes, int] = {}
    size = 0
    order = np.argsort(rows["key"].to_numpy(np.int64), kind="stable")
    first, count = packed.runs(rows["key"].to_numpy(np.int64)[order])
    order = order.tolist()
    for a, c in zip(first.tolist(), count.tolist()):
        if c == 1:
            continue
        owner: dict[bytes, int] = {}  # the row of a piece; -1 if it stands twice as a whole and is marked
        for i in order[a:a + c]:
            before = owner.setdefault(body[i], i)
            if before != i:
                for k in (before, i):
                    if k >= 0 and n[k]:
                        out.append((k, np.array([off[k], off[k] + len(body[k]) - length + 1], "<u4").tobytes()))
                owner[body[i]] = -1
        if len(owner) > 1:
            batch |= owner
            size += sum(map(len, owner))
            if size >= SORT_BYTES:
                sort(batch)
                batch, size = {}, 0
    if batch:
        sort(batch)
    at = [i for i, _ in out]
    return pd.DataFrame({"oid": oid[at], "tk": tk[at], "pos": [p for _, p in out]})


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pairs = np.stack((b["off"], b["off"] + b["n"]), axis=1).astype("<u4")
        yield b[["oid", "tk"]].assign(pos=[p.tobytes() for p in pairs])


def _marks(pieces: DataFrame, length: int, buckets: int, hot_bytes: int) -> DataFrame:
    """Ranges of marked windows of all pieces, level by level where an anchor is hot."""
    out = pieces.where("body IS NULL").mapInPandas(_ranges, packed.DOCUMENT)
    pieces = pieces.where("body IS NOT NULL")
    for segment in SEGMENTS:
        hot = written(pieces.groupBy("key").agg(F.sum(F.octet_length("body")).alias("size")).where(F.col("size") > hot_bytes).select("key"), "hot")
        crowded = not hot.isEmpty()
        calm = pieces.join(hot, "key", "left_anti") if crowded else pieces
        out = out.unionAll(calm.groupBy("bucket").applyInPandas(lambda r: _sorted(r, length), packed.DOCUMENT))
        if not crowded:
            return out
        pieces = written(pieces.join(hot, "key", "left_semi").select(calm.columns).mapInPandas(
            partial(_cut, length=length, segment=segment, buckets=buckets), _PIECES), "pieces")
    # Single windows: equal keys are equal strings, so a count decides.
    twice = pieces.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return out.unionAll(pieces.join(twice, "key", "left_semi").where("n > 0").select("oid", "tk", "off", "n").mapInPandas(_ranges, packed.DOCUMENT))


def dedup(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id",
          bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES, as_text: bool = False) -> DataFrame:
    """doc (all input columns), n_bytes, n_removed, n_spans, spans (start, end, ... in bytes), kept.

    kept holds the bytes that stay; with `as_text` a string, without the characters that the cuts broke.
    """
    body = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    rows = docs.select(row_struct(docs), F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("oid"),
                       F.xxhash64(body).alias("tk"))
    body = F.coalesce(F.col("doc").getField(text).cast("binary"), F.lit(b""))
    size = rows.agg(F.sum(F.octet_length(body))).first()[0] or 0
    buckets = int(size // bucket_bytes) + 1
    hits = packed.by_document(rows.select("oid", "tk", body.alias("text")).mapInPandas(
        partial(_probes, length=length, buckets=buckets), packed.PACKED).groupBy("bucket").applyInPandas(
        lambda frame: _hits(frame, buckets), packed.PLACES), "hits")
    found = rows.select("oid", "tk", body.alias("text")).join(hits, ["oid", "tk"])
    pieces = written(found.mapInPandas(partial(_pieces, length=length, buckets=buckets), _PIECES), "pieces")
    marks = _marks(pieces, length, buckets, hot_bytes).groupBy("oid", "tk").agg(F.collect_set("pos").alias("marks"))

    text_of = (lambda b: b.decode("utf-8", "ignore")) if as_text else (lambda b: b)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, spans array<long>, kept " + ("string" if as_text else "binary"))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, marked in batches:
            out = []
            for t, m in zip(texts, marked):
                if m is None or not len(m):
                    out.append((len(t), 0, 0, [], text_of(t)))
                    continue
                p = np.concatenate([np.frombuffer(x, "<u4") for x in m]).astype(np.int64).reshape(-1, 2)
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, p[:, 0], 1)
                np.subtract.at(edge, p[:, 1] + length - 1, 1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((len(t), int(gone.sum()), len(turn) // 2, turn.tolist(), text_of(kept)))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.join(marks, ["oid", "tk"], "left").select("doc", cut(body, "marks").alias("r")).select("doc", "r.*")
