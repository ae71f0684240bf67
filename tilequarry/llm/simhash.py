"""SimHash near-duplicates found through a generalised pigeonhole index.

A fingerprint has 64 bits, each set where over half the document's shingle hashes have
it.  Two fingerprints link at `radius` or fewer differing bits.  To find the links the
bits are cut into partitions and each partition i gets a threshold t_i such that
sum(t_i + 1) = radius + 1: a pair within the radius then differs in at most t_i bits of
some partition.  Correlated bits share a partition, so that the others stay selective,
and partitions and thresholds (-1: not probed) are those with the least estimated work:
probe rows plus candidates, by dynamic programming.

Every fingerprint is indexed under its value of each partition and probes all values
within t_i.  Equal keys meet after one shuffle, sorted, as a stream; candidates are
verified there and only a spanning forest of the links leaves the task, so a group of k
near copies gives about k rows.  A key with more than `run_limit` rows is not paired off but
dealt out again under longer keys (the exact pigeonhole over four or more parts), up to
LEVELS times; what is crowded still is linked to a pivot, and the rest of the key is compared
with all of it in blocks of `run_limit` rows, spread over tasks: nothing is dropped.

Defined results: null and blank texts have fingerprint zero and link like any other;
exact copies share a fingerprint and thus a class, and are never paired; a null doc_id
is carried and never names a class unless all ids of the class are null; an empty table
gives an empty result; only doc_id and text are read, whatever else the table holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.llm.common import Scratch, released, row_struct, written
from tilequarry.llm.components import components

BITS = 64
#: Relative work of one probe row (shuffled, sorted) and one candidate (an XOR and a count).
PROBE_WORK, CANDIDATE_WORK = 50.0, 1.0
#: Rows of one key that are paired off directly; more are dealt out under longer keys.
RUN_LIMIT = 20_000
#: Times a crowded key is made longer.  After three, rows of a key agree in 16 bits thrice over, overlapping in
#: part; what is still together then is mostly near indeed, so that a pivot links most of it.
LEVELS = 3
_SLICE = 1 << 16
_POWER = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


# ---- fingerprints -------------------------------------------------------------------

def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `size` words; of the whole sequence if there are fewer; none: empty."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter((digest(line[a:b], seed) for a, b in pairs), np.uint64, len(found) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits; no hashes: zero."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), _SLICE):
        part = np.ascontiguousarray(hashes[a:a + _SLICE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_POWER[2 * ones > len(hashes)].sum(dtype=np.uint64))


@released
def _fingerprints(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = np.array([fingerprint(shingle_hashes(t, size)) for t in b["text"]], np.uint64)
        yield b.drop(columns="text").assign(fp=fps.view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    plain = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("text"))
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, fp long"
    return plain.mapInPandas(partial(_fingerprints, size=shingle), schema)


# ---- the index plan -----------------------------------------------------------------

def _bit_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        bits = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += (bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
    yield pd.DataFrame({"i": np.repeat(np.arange(BITS), BITS), "j": np.tile(np.arange(BITS), BITS), "n": total.ravel()})


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over all fingerprints; 4,096 numbers whatever the input."""
    out = np.zeros((BITS, BITS))
    for r in fps.mapInPandas(_bit_pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def group_bits(pairs: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` partitions of nearly equal width, correlated ones together."""
    mean = np.diag(pairs) / max(n, 1)
    var = np.maximum(mean * (1 - mean), 1e-9)
    corr = np.abs(pairs / max(n, 1) - np.outer(mean, mean)) / np.sqrt(np.outer(var, var))
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        mine = [max(free, key=lambda b: (corr[b, sorted(free - {b})].max(initial=0.0), -b))]
        free -= set(mine)
        while len(mine) < width:
            best = max(free, key=lambda b: (corr[b, mine].sum(), -b))
            mine.append(best)
            free.remove(best)
        out.append(sorted(mine))
    return out


def _within(mean: np.ndarray, most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t of these bits, t = 0..most."""
    dist = np.zeros(len(mean) + 1)
    dist[0] = 1.0
    for p in mean:
        q = 2 * p * (1 - p)
        dist[1:], dist[0] = dist[1:] * (1 - q) + dist[:-1] * q, dist[0] * (1 - q)
    return list(np.cumsum(dist)[: most + 1])


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan_index(pairs: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition, for n fingerprints with these bit statistics."""
    best: tuple[float, list] = (float("inf"), [])
    mean = np.diag(pairs) / max(n, 1)
    for parts in range(2, min(16, radius + 2) + 1):
        groups = group_bits(pairs, n, parts)
        # table[s]: least work and thresholds with sum(t + 1) = s over the groups so far
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            share = _within(mean[bits], radius)
            work = {-1: 0.0}
            for t in range(min(radius, len(bits)) + 1):
                probes = sum(_choose(len(bits), k) for k in range(t + 1))
                work[t] = (probes + 1) * PROBE_WORK + n * share[t] * CANDIDATE_WORK
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, ts) in table.items():
                for t, w in work.items():
                    if s + t + 1 <= radius + 1 and cost + w < new.get(s + t + 1, (float("inf"),))[0]:
                        new[s + t + 1] = (cost + w, [*ts, t])
            table = new
        cost, ts = table[radius + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


# ---- probing ------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _masks(bits: list[int], most: int) -> np.ndarray:
    """All masks of up to `most` of these bits, zero first."""
    out = [np.zeros(1, np.uint64)]
    level = [(0, -1)]
    for _ in range(most):
        level = [(m | 1 << b, k) for m, last in level for k, b in enumerate(bits) if k > last]
        out.append(np.array([m for m, _ in level], np.uint64))
    return np.concatenate(out)


@released
def _keys(batches: Iterator[pd.DataFrame], plan: list[tuple[list[int], int]]) -> Iterator[pd.DataFrame]:
    """key, fp, probe: a row under each partition's own value (both roles) and one for each value probed."""
    ready = [(np.uint64(k + 1), np.uint64(sum(1 << b for b in bits)), _masks(bits, t)) for k, (bits, t) in enumerate(plan)]
    for b in batches:
        fps = _words(b["fp"])
        for a in range(0, len(fps), 4096):
            fp = fps[a:a + 4096]
            for part, mask, flips in ready:
                keys = _mix(_mix((fp & mask)[:, None] ^ flips[None, :]) + part).ravel()
                probe = np.tile(np.arange(len(flips)) > 0, len(fp))
                yield pd.DataFrame({"key": keys.view(np.int64), "fp": np.repeat(fp, len(flips)).view(np.int64), "probe": probe})


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels after adding the edges a-b; labels are the least index of each component."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
        label = up[label]


def _words(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> pd.DataFrame:
    """A spanning forest of the links among rows of equal key; rows are sorted by key."""
    n = len(key)
    label = np.arange(n)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.empty(0, int)
    end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    at = np.arange(n)
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        to = at + step
        apart = np.bitwise_count(fp[at] ^ fp[to])
        near = ~(probe[at] & probe[to]) & (apart <= radius) & (apart > 0)
        if near.any():
            label = _join(label, at[near], to[near])
        step += 1
    moved = np.flatnonzero(label != np.arange(n))
    a, b = fp[moved].view(np.int64), fp[label[moved]].view(np.int64)
    out = pd.DataFrame({"u": a, "v": b, "key": 0, "probe": False, "again": False})
    return out[out["u"] != out["v"]]


def _again(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, level: int, radius: int) -> pd.DataFrame:
    """Rows of a crowded key under longer keys: one for each of radius + 1 parts of the bits (four at least), rotated by the level."""
    nodes, turn = fp.view(np.int64), np.uint64(8 * level % BITS)
    parts = max(4, radius + 1)
    turned = (fp << turn) | (fp >> np.uint64((BITS - int(turn)) % BITS)) if turn else fp
    out = []
    for q in range(parts):
        low, high = BITS * q // parts, BITS * (q + 1) // parts
        part = (turned >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        longer = _mix(_mix(key + part) + np.uint64(q + 11))
        out.append(pd.DataFrame({"u": nodes, "v": nodes, "key": longer.view(np.int64), "probe": probe, "again": True}))
    return pd.concat(out)


@released
def _stream(batches: Iterator[pd.DataFrame], radius: int, run_limit: int, level: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, batch by batch; no more than a batch and `run_limit` rows are held."""
    held: list[np.ndarray] | None = None
    crowded: np.uint64 | None = None
    for b in batches:
        if not len(b):
            continue
        new = [b["key"].to_numpy(np.int64).view(np.uint64), _words(b["fp"]), b["probe"].to_numpy(bool)]
        cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if crowded is not None:
            rest = int(np.count_nonzero(cols[0] == crowded))  # they come first
            yield _again(*[c[:rest] for c in cols], level, radius)
            cols = [c[rest:] for c in cols]
        crowded, held = None, None
        if not len(cols[0]):
            crowded = new[0][-1]
            continue
        sizes_at = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        last = sizes_at[-1]
        sizes = np.diff(np.append(sizes_at, len(cols[0])))
        if sizes[-1] > run_limit:
            crowded = cols[0][-1]
        else:
            held = [c[last:] for c in cols]
        done = len(cols[0]) if crowded is not None else last
        big = np.repeat(sizes > run_limit, sizes)[:done]
        if big.any():
            yield _again(*[c[:done][big] for c in cols], level, radius)
        yield _links(*[c[:done][~big] for c in cols], radius)
    if held is not None:
        yield _links(*held, radius)


def _blocks(rows: DataFrame, radius: int, run_limit: int) -> tuple[DataFrame, DataFrame]:
    """Crowded keys cut up: u, v of rows near the key's pivot, and all rows under keys of bounded size.

    Rows near the pivot are connected by it, so only the others need to meet every row of the key: they and the whole
    key are cut into blocks of about `run_limit` rows, and each pair of blocks has a key of its own.
    """
    pivots = rows.groupBy("key").agg(F.count("*").alias("k"), F.min("fp").alias("pivot"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius
    rows = written(rows.join(pivots, "key").withColumn("near", near | (F.col("k") <= run_limit)), "crowded")
    big = rows.where(F.col("k") > run_limit)
    stars = big.where("near AND fp <> pivot").select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct()
    apart = big.where("NOT near").groupBy("key").agg(F.count("*").alias("s"))
    across = lambda size: F.ceil(F.col(size) / F.lit(run_limit)).cast("int")
    block = lambda size: F.pmod(F.xxhash64("fp", "probe"), across(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), across(size) - 1))
    big = big.join(apart, "key")
    left = big.where("NOT near").select("key", "fp", "probe", block("s").alias("i"), every("k").alias("j"))
    right = big.select("key", "fp", "probe", block("k").alias("j"), every("s").alias("i"))
    dealt = left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("key"), "fp", "probe").distinct()
    return stars, dealt.unionAll(rows.where(F.col("k") <= run_limit).select("key", "fp", "probe"))


def _connect(rows: DataFrame, radius: int, run_limit: int) -> DataFrame:
    """u, v of the rows (key, fp, probe) that link under some key."""
    out, level = None, 0
    while True:
        limit = run_limit
        if level == LEVELS:
            stars, rows = _blocks(rows, radius, run_limit)
            limit, out = 1 << 62, out.unionAll(stars)  # no key has more rows than two blocks
        dealt = rows.repartition("key").sortWithinPartitions("key")
        found = written(dealt.mapInPandas(partial(_stream, radius=radius, run_limit=limit, level=level),
                                          "u long, v long, key long, probe boolean, again boolean"), "links")
        edges = found.where("NOT again").select("u", "v").distinct()
        out = edges if out is None else out.unionAll(edges)
        again = found.where("again")
        if again.isEmpty():
            return out
        rows, level = again.select("key", F.col("u").alias("fp"), "probe").distinct(), level + 1


def links(fps: DataFrame, radius: int = 3, run_limit: int = RUN_LIMIT) -> DataFrame:
    """u, v: edges that connect exactly the distinct fingerprints linked by a chain of near pairs."""
    plan = plan_index(bit_statistics(fps), fps.count(), radius)
    return _connect(fps.mapInPandas(partial(_keys, plan=plan), "key long, fp long, probe boolean"), radius, run_limit)


def classes(docs: DataFrame, shingle: int = 3, radius: int = 3, text: str = "text", key: str = "doc_id",
            run_limit: int = RUN_LIMIT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, the document's own included."""
    fps = written(fingerprints(docs, shingle, text, key), "fingerprints")
    named = _named(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), radius, run_limit)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _named(first: DataFrame, radius: int, run_limit: int) -> DataFrame:
    """fp, first, root: the class of each different fingerprint, named by one of its fingerprints."""
    first = written(first, "fingerprints")
    roots = components(links(first.select("fp"), radius, run_limit))
    return first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def _keyed(docs: DataFrame, text: str, key: str) -> list[Column]:
    """oid and tk: doc_id (null: the smallest long) and the text's hash."""
    body = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    return [F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("oid"), F.xxhash64(body).alias("tk")]


def _rows_of(docs: DataFrame, winners: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of docs that winners (oid, tk) name, one for each; which of several with equal id and text follows their other columns."""
    rows = docs.select(row_struct(docs), *_keyed(docs, text, key))
    same = Window.partitionBy("oid", "tk").orderBy(F.xxhash64("doc"))
    kept = rows.join(winners, ["oid", "tk"]).withColumn("copy", F.row_number().over(same)).where("copy = 1")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 3, text: str = "text", key: str = "doc_id",
               run_limit: int = RUN_LIMIT) -> DataFrame:
    """The documents less the others of each class that links of fingerprints make: the one whose doc_id names the class stays.

    Of rows with that doc_id one stays (the smallest text hash); a null doc_id stays only where the class has no other.
    """
    body = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    plain = docs.select(docs[key].isNull().alias("nameless"), *_keyed(docs, text, key), body.alias("text"))
    fps = plain.mapInPandas(partial(_fingerprints, size=shingle), "nameless boolean, oid long, tk long, fp long")
    named = _named(fps.groupBy("fp").agg(F.min(F.struct("nameless", "oid", "tk")).alias("first")), radius, run_limit)
    winners = named.groupBy("root").agg(F.min("first").alias("w")).select("w.oid", "w.tk")
    return _rows_of(docs, winners, text, key)


# ---- near copies by their shingle sets ---------------------------------------------------

#: Counters of the sketch by which shingles are ordered, rare ones first, and counters of one row of it.
#: The order decides how much is compared, never what is found.
SKETCH, _CELLS = 1 << 20, 4096
#: Rank of a counter with a million shingles, and the parts into which the rows of its shingles go.
CROWDED, SALTS = 160, 1024
#: Rounds that compare with pivots only, before whatever is not linked yet is compared pair by pair.
PIVOTS = 4


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The different shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, size))


@released
def _digests(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """oid, tk and the digest of the shingle set; at the end the task's part of the sketch (cell, counts)."""
    counts = np.zeros(SKETCH, np.int64)
    for b in batches:
        digests, held, n = [], [], 0
        for t in b["text"]:
            h = shingle_set(t, size)
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            held.append(h)
            n += len(h)
            if n > SKETCH:
                counts += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                held, n = [], 0
        if n:
            counts += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        yield b[["oid", "tk"]].assign(digest=digests, cell=-1, counts=None)
    if counts.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(-1, _CELLS)]
        yield pd.DataFrame({"oid": 0, "tk": 0, "digest": None, "cell": np.arange(len(parts)), "counts": parts})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for cell, counts in zip(b["cell"], b["counts"]):
            total[cell] = total.get(cell, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
    yield pd.DataFrame({"cell": list(total), "counts": [np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in total.values()]})


def _need(n: np.ndarray | int, similarity: float) -> np.ndarray | int:
    """Shingles that a set of n shares at least with any set so similar to it."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


@released
def _prefixes(batches: Iterator[pd.DataFrame], size: int, similarity: float, rank: np.ndarray, crowded: int) -> Iterator[pd.DataFrame]:
    """token, salt, node, n, pos: the rarest shingles of each set, as many as any set similar enough must meet one of.

    A shingle that is alone in its counter of the sketch (rank 8) is in no other set and makes no row.  One whose
    counter is crowded is salted by its set, as it needs no counting; the salt of the others is -1.
    """
    for b in batches:
        for a in range(0, len(b), 500):
            out = []
            for node, t in zip(b["node"][a:a + 500], b["text"][a:a + 500]):
                h = shingle_set(t, size)
                n = len(h)
                if not n:
                    continue
                r = rank[(h % np.uint64(SKETCH)).astype(np.int64)]
                first = np.lexsort((_mix(h), r))[: n - int(_need(np.int64(n), similarity)) + 1]
                pos = np.flatnonzero(r[first] > 8)
                salt = np.where(r[first[pos]] >= crowded, int(node) % SALTS, -1)
                out.append(pd.DataFrame({"token": h[first[pos]].view(np.int64), "salt": salt, "node": node, "n": n, "pos": pos}))
            if out:
                yield pd.concat(out)


@released
def _sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), 500):
            part = b[a:a + 500]
            yield pd.DataFrame({"node": part["node"], "shingles": [shingle_set(t, size).view(np.int64) for t in part["text"]]})


def _fits(left: str, right: str, similarity: float) -> Column:
    """Whether sets that meet in this shingle first can share enough, by their sizes and its places."""
    rest = F.least(F.col(f"{left}.n") - F.col(f"{left}.pos"), F.col(f"{right}.n") - F.col(f"{right}.pos"))
    return rest >= similarity / (1 + similarity) * (F.col(f"{left}.n") + F.col(f"{right}.n")) - 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v of the pairs whose sets are this similar, by the sets themselves."""
    x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    both = pairs.join(x, "u").join(y, "v").withColumn("common", F.size(F.array_intersect("x", "y")))
    return written(both.where(F.col("common") / (F.size("x") + F.size("y") - F.col("common")) >= similarity).select("u", "v"), "links")


def _pair(left: str, right: str) -> list[Column]:
    a, b = F.col(f"{left}.node"), F.col(f"{right}.node")
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _set_links(shared: DataFrame, sets: DataFrame, similarity: float, run_limit: int) -> DataFrame:
    """u, v: edges that connect exactly the nodes which a chain of pairs this similar connects.

    `shared` has the rows (token, node, n, pos) of the index.  Sets under one token are compared with a pivot first.
    Then, token by token, all outside the token's largest class so far meet all others of another class, in blocks
    of `run_limit` rows, each pair of blocks under a key of its own.
    """
    links, rows, before = None, shared.withColumn("label", F.col("node")), None
    for k in range(PIVOTS + 1):
        counts = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
        sizes = written(counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("k"),
                                                    (F.sum("c") - F.max("c")).alias("s")).where("s > 0"), "sizes")
        work, n = sizes.agg(F.sum(F.col("s").cast("double") * F.col("k")), F.sum("k")).first()
        if not n:
            return links if links is not None else shared.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
        mixed = rows.join(sizes, "token")
        if k:  # a token whose sets are all of one class stays so and drops out
            mixed = written(mixed, "mixed")
            shared = mixed.select(*shared.columns)
        if k == PIVOTS or k and (work <= 8 * n or before is not None and work > before / 2):
            break
        before = work if k else None
        # A few pivots for each group of near copies, whichever of their shingles they meet in.
        outside = mixed if not k else mixed.where("label <> major")
        pivots = outside.groupBy("token").agg(F.min_by(F.struct("node", "n", "pos", "label"), F.xxhash64("node", F.pmod("token", F.lit(4)), F.lit(k))).alias("p"))
        met = mixed.alias("l").join(pivots, "token").where((F.col("l.label") != F.col("p.label")) & _fits("l", "p", similarity))
        found = _verified(met.select(*_pair("l", "p")).distinct(), sets, similarity)
        links = found if links is None else links.unionAll(found)
        roots = components(links)
        rows = shared.join(roots, "node", "left").select(*shared.columns, F.coalesce("root", "node").alias("label"))
    across = lambda size: F.ceil(F.col(size) / F.lit(run_limit)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), across(size) - 1))
    columns = ["token", "node", "n", "pos", "label", "major"]
    left = mixed.where("label <> major").select(*columns, F.pmod(F.xxhash64("node"), across("s")).cast("int").alias("i"), every("k").alias("j"))
    right = mixed.select(*columns, F.pmod(F.xxhash64("node"), across("k")).cast("int").alias("j"), every("s").alias("i"))
    met = left.alias("l").join(right.alias("r"), ["token", "i", "j"]).where(
        (F.col("l.label") != F.col("r.label")) & ((F.col("r.label") == F.col("r.major")) | (F.col("l.node") < F.col("r.node")))
        & _fits("l", "r", similarity))
    found = _verified(met.select(*_pair("l", "r")).distinct(), sets, similarity)
    return found if links is None else links.unionAll(found)


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id",
                run_limit: int = RUN_LIMIT, crowded: int = CROWDED) -> DataFrame:
    """oid, tk, component: classes of documents that chains of pairs with at least this Jaccard similarity connect.

    Shingle sets are compared as sets of 64-bit hashes.  Equal sets collapse first.  Candidates come from a prefix
    filter: in any order of all shingles, two sets this similar share one of the first n - ceil(similarity * n) + 1 of
    each, so none is missed, whatever the number of documents; each candidate is then decided by the sets
    themselves.  oid is the doc_id (null: the smallest long), tk the text's hash.
    """
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    plain = docs.select(F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("oid"), F.xxhash64(body).alias("tk"), body.alias("text"))
    seen = written(plain.mapInPandas(partial(_digests, size=shingle), "oid long, tk long, digest binary, cell int, counts binary"), "digests")
    rank = np.zeros(SKETCH, np.uint8)
    for r in seen.where("cell >= 0").select("cell", "counts").repartition("cell").mapInPandas(_summed, "cell int, counts binary").collect():
        rank[r.cell * _CELLS:(r.cell + 1) * _CELLS] = np.frombuffer(r.counts, np.uint8)
    seen = seen.where("cell < 0").select("oid", "tk", "digest")
    first = seen.groupBy("digest").agg(F.min(F.struct("oid", "tk")).alias("w"))
    first = written(first.select("digest", "w.oid", "w.tk", F.monotonically_increasing_id().alias("node")), "sets")
    same = Window.partitionBy("oid", "tk").orderBy("node")
    texts = plain.join(first.select("oid", "tk", "node"), ["oid", "tk"]).withColumn("copy", F.row_number().over(same))
    texts = scratch.written(texts.where("copy = 1").select("node", "text"), "texts")
    index = texts.mapInPandas(partial(_prefixes, size=shingle, similarity=similarity, rank=rank, crowded=crowded),
                              "token long, salt int, node long, n int, pos int")
    # Shingles of a crowded counter stay uncounted: those alone after all link nothing later on.
    often = index.withColumn("k", F.count("*").over(Window.partitionBy("token", "salt"))).where("salt >= 0 OR k > 1")
    shared = written(often.select("token", "node", "n", "pos"), "index")
    # Stored, so that Spark knows their number and, while they are few, moves no text to them.
    nodes = scratch.written(shared.select("node").distinct(), "nodes")
    sets = written(texts.join(nodes, "node", "left_semi").mapInPandas(partial(_sets, size=shingle), "node long, shingles array<long>"), "sets")
    scratch.drop(texts, nodes)
    roots = components(_set_links(shared, sets, similarity, run_limit))
    named = first.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    return seen.join(named, "digest").select("oid", "tk", "component")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id",
             run_limit: int = RUN_LIMIT) -> DataFrame:
    """The documents less near copies: of each class the one with the smallest doc_id (then text hash) stays."""
    winners = near_copies(docs, shingle, similarity, text, key, run_limit).groupBy("component").agg(
        F.min(F.struct("oid", "tk")).alias("w")).select("w.oid", "w.tk")
    return _rows_of(docs, winners, text, key)
