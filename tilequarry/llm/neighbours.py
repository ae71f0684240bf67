"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt to inverted lists and rotated at random, so that any leading part of the rotated dimensions is a
fair sample of a distance.  A query looks at its nearest lists.  There, vectors lie column by column in blocks of
dimensions; after each block a hypothesis test compares every partial distance with the distance to beat, and
candidates that can hardly come below it are abandoned.  What survives is measured on the original vectors in double
precision, and the k-th of what was found is the distance to beat from then on.

Lists have two levels of centroids, both fitted on a bounded sample: coarse ones, and residuals that all coarse ones
share, so there is a list for each pair of them.  The number of lists is the square root of the number of vectors at
every size.  The number of lists a query probes is the least that finds `CALIBRATED` of the sample's own
neighbours, and more where its lists hold too few vectors.  Queries travel to the lists; vectors are stored once, in
blocks of rows, so a list with a third of all vectors is many tasks' work.  A task holds one block of rows and
streams the queries past it; only a block that is asked by more than `QUERY_BLOCK` queries is held by further tasks.

Each query also measures some vectors of the sample, the pilot, for its first distance to beat.  They count as found.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as query or candidate; ties go to the smaller vec_id; rows with a null vec_id take no part;
repeated rows are candidates each on its own, but no row with the query's vec_id is its neighbour; query rows of one vec_id answer
once, with the least of their vectors; fewer than k candidates are all returned where all lists are probed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most vectors the index is fitted on, vectors of that sample for each centroid, and centroids of the coarse level.
SAMPLE, PER_LIST, COARSE = 65_536, 32, 2_048
#: Share of the sample's neighbours that the probed lists must hold, and lists probed beyond those.
CALIBRATED, BEYOND = 0.98, 1.1
#: Dimensions per block, and the strictness of the test: higher abandons less.
COLUMNS, STRICT = 16, 2.1
#: Rows of a list, and queries, that one task compares.
ROW_BLOCK, QUERY_BLOCK = 16_384, 65_536
#: Rows and queries compared at once, and pairs measured at once.
_ROWS, _QUERIES, _PAIRS = 4_096, 256, 65_536
_PILOT = 1_024


@dataclass
class Index:
    dim: int
    rotation: np.ndarray  # dim x dim, orthogonal
    coarse: np.ndarray  # centroids x dim, in original coordinates
    residuals: np.ndarray  # centroids of what the coarse level leaves x dim
    sizes: np.ndarray  # vectors per list
    probes: int
    pilot: np.ndarray  # vectors of the sample that give each query a first distance to beat
    pilot_ids: np.ndarray


def usable(vec: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part."""
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return fine if dim is None else fine & (F.size(vec) == dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _cluster(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(x[a:a + 8192], centroids).argmin(1) for a in range(0, len(x), 8192)])
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=lists)
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[a:a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _list_of(x: np.ndarray, coarse: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """The list of each vector: nearest coarse centroid, then nearest residual."""
    first = _nearest(x, coarse)
    return first * len(residuals) + _nearest(x - coarse[first], residuals)


def _centres(coarse: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    return (coarse[:, None] + residuals[None]).reshape(-1, coarse.shape[1])


def _calibrate(x: np.ndarray, coarse: np.ndarray, residuals: np.ndarray, k: int, share: float) -> int:
    """Lists to probe so that `share` of the k nearest in the sample are found."""
    q = x[:256]
    d = _squares(q, x)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :min(k, len(x) - 1)]
    home = _list_of(x, coarse, residuals)
    centres = _centres(coarse, residuals)
    ranks = np.concatenate([
        np.take_along_axis(np.argsort(np.argsort(_squares(q[a:a + 32], centres), axis=1), axis=1), home[near[a:a + 32]], axis=1).ravel()
        for a in range(0, len(q), 32)])
    ranks.sort()
    return int(ranks[min(len(ranks) - 1, int(share * len(ranks)))]) + 1


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def fit(vectors: DataFrame, dim: int, n: int, k: int, seed: int = 11, coarse: int = COARSE) -> Index:
    """The index of vectors (vec_id, vec); only the sample and one count for each list reach the driver."""
    lists = max(1, min(int(math.sqrt(n)), n // PER_LIST))
    first = min(lists, coarse)
    wanted = min(SAMPLE, first * PER_LIST)
    every = max(1, n // wanted)
    hashed = F.xxhash64("vec_id", F.lit(seed))
    rows = vectors.where(F.pmod(hashed, F.lit(every)) == 0).select("vec_id", "vec").limit(2 * SAMPLE).toPandas() if n else pd.DataFrame({"vec_id": [], "vec": []})
    rows = rows.sort_values("vec_id", kind="stable")
    x = _matrix(rows["vec"]).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    first = max(1, min(first, len(x)))
    top = _cluster(x, first, rng) if len(x) else np.zeros((1, dim))
    below = max(1, min(-(-lists // first), len(x)))
    residuals = _cluster(x - top[_nearest(x, top)], below, rng) if below > 1 else np.zeros((1, dim))
    lists = len(top) * len(residuals)
    order = rng.permutation(len(x))
    probes = min(lists, math.ceil(BEYOND * _calibrate(x[order], top, residuals, k, CALIBRATED))) if len(x) > 1 else lists
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    pilot = order[:_PILOT]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"list": _list_of(_matrix(b["vec"]).reshape(-1, dim), top, residuals)})

    sizes = np.zeros(lists, np.int64)
    for r in vectors.select("vec").mapInPandas(assign, "list long").groupBy("list").count().collect():  # one row for each list
        sizes[r["list"]] = r["count"]
    return Index(dim, rotation, top, residuals, sizes, probes, x[pilot], rows["vec_id"].to_numpy()[pilot])


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, k - 1)[k - 1]) if len(values) >= k else math.inf


def scan_pairs(rotated: np.ndarray, queries: np.ndarray, beat: np.ndarray, columns: int = COLUMNS,
               strict: float = STRICT) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may come below each query's distance to beat.

    rotated: dimensions x rows; queries: rotated too; beat: squared distances, possibly infinite.
    While most pairs live, a block of dimensions is compared for all of them at once; rows and queries without a
    living pair leave, and once few pairs live only those are carried on.
    """
    dim, n = rotated.shape
    rounding = 1e-12 * ((queries * queries).sum(1) + float((rotated * rotated).sum(0).max(initial=0)))
    beat = beat * (1 + 1e-9) + rounding + 1e-12

    def limit(b: int) -> np.ndarray:
        return beat if b == dim else beat * b / dim * (1 + strict / math.sqrt(b)) ** 2

    asks, rows = np.arange(len(queries)), np.arange(n)
    partial = np.zeros((len(asks), n))
    b = 0
    while b < dim:
        a, b = b, min(b + columns, dim)
        partial = partial + _squares(queries[asks, a:b], rotated[a:b, rows].T)
        keep = partial <= limit(b)[asks, None]
        if b == dim or keep.mean() < 0.05:
            break
        some, any_row = keep.any(1), keep.any(0)
        partial = np.where(keep, partial, np.inf)[np.ix_(some, any_row)]
        asks, rows = asks[some], rows[any_row]
        if not len(asks):
            return asks, asks
    i, j = np.nonzero(keep)
    partial, qi, ri = partial[i, j], asks[i], rows[j]
    while b < dim and len(qi):
        a, b = b, min(b + columns, dim)
        partial = partial + ((rotated[a:b, ri] - queries[qi, a:b].T) ** 2).sum(0)
        alive = partial <= limit(b)[qi]
        partial, qi, ri = partial[alive], qi[alive], ri[alive]
    return qi, ri


def scan(rotated: np.ndarray, query: np.ndarray, beat: float, k: int, columns: int = COLUMNS, strict: float = STRICT) -> np.ndarray:
    """Rows that may be among the k nearest to a rotated query; rotated: dimensions x rows.

    beat: a squared distance that k vectors are known to reach, or infinity; then the first rows are measured in full.
    """
    def measured(rows) -> np.ndarray:
        return ((rotated[:, rows] - query[:, None]) ** 2).sum(0)

    if not math.isfinite(beat):
        beat = _kth(measured(slice(0, 4 * k)), k)
    rows = scan_pairs(rotated, query[None], np.array([beat]), columns, strict)[1]
    d = measured(rows)
    return rows[d <= _kth(d, k) * (1 + 1e-9) + 1e-12]


def _measure(x: np.ndarray, v: np.ndarray, ri: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, in bounded pieces."""
    return np.concatenate([((x[ri[a:a + _PAIRS]] - v[qi[a:a + _PAIRS]]) ** 2).sum(1) for a in range(0, len(ri), _PAIRS)] or [np.zeros(0)])


def _best(qi: np.ndarray, ids: np.ndarray, squared: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k nearest, ties to the smaller id; in order of query and nearness."""
    order = np.lexsort((ids, squared, qi))
    q = qi[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def nearest(x: np.ndarray, ids: np.ndarray, rotated: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_rotated: np.ndarray,
            beat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of each query's k nearest rows that beat its distance; beat is tightened on the way."""
    beat = beat.copy()
    qi, found, squared = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for a in range(0, len(x), _ROWS):
        part = slice(a, a + _ROWS)
        q, r = scan_pairs(rotated[:, part], v_rotated, beat)
        others = ids[part][r] != v_ids[q]
        q, r = q[others], r[others]
        qi, found = np.concatenate([qi, q]), np.concatenate([found, ids[part][r]])
        squared = np.concatenate([squared, _measure(x[part], v, r, q)])
        top = _best(qi, found, squared, k)
        qi, found, squared = qi[top], found[top], squared[top]
        full = np.searchsorted(qi, np.arange(len(v)), "right") - 1
        whole = np.bincount(qi, minlength=len(v)) == k
        beat[whole] = np.minimum(beat[whole], squared[full[whole]])
    return qi, found, squared


def _pilot_nearest(index: Index, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rotated = (index.pilot @ index.rotation).T
    return nearest(index.pilot, index.pilot_ids, rotated, v, v_ids, v @ index.rotation, np.full(len(v), np.inf), k)


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec: str = "embedding", key: str = "vec_id",
           row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, coarse: int = COARSE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean): the k nearest found for every row where is_query holds."""
    own = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vec].cast("array<double>").alias("vec"),
                         F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = own.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    common = valid.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (common["d"], common["count"]) if common else (1, 0)
    valid = valid.where(F.size("vec") == dim)
    index = fit(valid.select("vec_id", "vec"), dim, n, k, coarse=coarse)
    blocks = np.maximum(1, -(-index.sizes // row_block))
    queries = valid.where("asks").groupBy("vec_id").agg(F.min("vec").alias("vec"))

    def probed(m: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(m), 32):
            for i, order in enumerate(np.argsort(_squares(m[a:a + 32], centres), axis=1, kind="stable"), a):
                # As many lists as it takes to find k others.
                enough = int(np.searchsorted(np.cumsum(index.sizes[order]), k + 1)) + 1
                yield i, order[:max(index.probes, enough)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = _centres(index.coarse, index.residuals)
        asked = np.zeros(len(centres), np.int64)
        for b in batches:
            for _, order in probed(_matrix(b["vec"]).reshape(-1, dim), centres):
                asked[order] += 1
        yield pd.DataFrame({"list": np.flatnonzero(asked), "n": asked[asked > 0]})

    asked = np.zeros(len(index.sizes), np.int64)
    for r in queries.mapInPandas(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # one row for each list
        asked[r["list"]] = r["n"]
    turns = np.maximum(1, -(-asked // query_block))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for b in batches:
            lists = _list_of(_matrix(b["vec"]).reshape(-1, dim), index.coarse, index.residuals)
            block = (np.arange(len(b)) + seen) % blocks[lists]
            seen += len(b)
            copies = turns[lists]
            at = np.repeat(np.arange(len(b)), copies)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pd.DataFrame({"list": lists[at], "block": block[at], "turn": turn, "tag": 0, "id": b["vec_id"].to_numpy()[at],
                                "vec": b["vec"].to_numpy()[at], "beat": 0.0})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = _centres(index.coarse, index.residuals)
        for whole in batches:
            for start in range(0, len(whole), _QUERIES):
                b = whole.iloc[start:start + _QUERIES]
                m, ids = _matrix(b["vec"]).reshape(-1, dim), b["vec_id"].to_numpy()
                q, _, squared = _pilot_nearest(index, m, ids, k)
                beat = [float(squared[q == i].max()) if (q == i).sum() == k else math.inf for i in range(len(m))]
                out = [(lst, blk, int(ids[i]) // 7 % int(turns[lst]), 1, ids[i], b["vec"].iat[i], beat[i])
                       for i, order in probed(m, centres) for lst in order.tolist() if index.sizes[lst] for blk in range(blocks[lst])]
                yield pd.DataFrame(out, columns=["list", "block", "turn", "tag", "id", "vec", "beat"])

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), _QUERIES):
                b = whole.iloc[start:start + _QUERIES]
                ids = b["vec_id"].to_numpy()
                q, found, squared = _pilot_nearest(index, _matrix(b["vec"]).reshape(-1, dim), ids, k)
                yield pd.DataFrame({"query_id": ids[q], "vec_id": found, "score": np.sqrt(squared)})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, x = None, [], None
        for b in batches:
            for place_of, group in b.groupby(["list", "block", "turn"], sort=False):
                if place_of != held:
                    held, rows, x = place_of, [], None
                mine, asking = group[group["tag"] == 0], group[group["tag"] == 1]
                if len(mine):
                    rows.append((_matrix(mine["vec"]), mine["id"].to_numpy()))
                if not len(asking) or not rows:
                    continue
                if x is None:  # all rows of a block come before its queries
                    x, ids = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                    rotated = np.ascontiguousarray((x @ index.rotation).T)
                for a in range(0, len(asking), _QUERIES):
                    some = asking.iloc[a:a + _QUERIES]
                    v, v_ids = _matrix(some["vec"]), some["id"].to_numpy()
                    q, found, squared = nearest(x, ids, rotated, v, v_ids, v @ index.rotation, some["beat"].to_numpy(), k)
                    yield pd.DataFrame({"query_id": v_ids[q], "vec_id": found, "score": np.sqrt(squared)})

    row = "list long, block long, turn long, tag int, id long, vec array<double>, beat double"
    keys = ["list", "block", "turn"]
    placed = valid.select("vec_id", "vec").mapInPandas(place, row).unionByName(queries.mapInPandas(ask, row))
    found = placed.repartition(*keys).sortWithinPartitions(*keys, "tag").mapInPandas(compare, "query_id long, vec_id long, score double")
    seeds = queries.mapInPandas(seed, "query_id long, vec_id long, score double")
    both = found.withColumn("listed", F.lit(1)).unionByName(seeds.withColumn("listed", F.lit(0))).repartition("query_id")
    # A vector of the pilot that a list gave as well counts once.
    twice = F.max("listed").over(Window.partitionBy("query_id", "vec_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return both.withColumn("most", twice).where("listed = most").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
