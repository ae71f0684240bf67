import numpy as np
from llm_helpers import SF_SMALL
from pyspark.sql import functions as F

from tilequarry.llm import neighbours
from tilequarry.llm.queries import QUERIES


def by_hand(x, ids, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    d[ids == q] = np.inf
    return np.lexsort((ids, d))[:k], d


def check(rows, x, ids, k):
    hits = total = 0
    for q in {r.query_id for r in rows}:
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        want, d = by_hand(x, ids, q, k)
        assert [r[0] for r in own] == list(range(1, k + 1))
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in own)
        hits, total = hits + len({v for _, v, _ in own} & set(ids[want].tolist())), total + k
    return hits / total


def test_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    found = QUERIES["op9_nearest_neighbours"](spark, SF_SMALL).collect()
    assert check(found, np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy(), 10) >= 0.9


def test_small_blocks_hot_list_and_ties(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((600, 20)), np.repeat(rng.standard_normal((1, 20)), 300, axis=0)])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # groups meet across partitions too
    try:
        found = neighbours.search(df, F.col("vec_id") % 50 == 0, k=5, row_block=40, query_block=3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert check(found, x, ids, 5) >= 0.9
    tied = sorted((r.rank, r.vec_id) for r in found if r.query_id == 650)
    assert [v for _, v in tied] == [600, 601, 602, 603, 604]


def test_two_levels_of_centroids_and_hot_queries(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] * 3 + rng.standard_normal((3000, 16))
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    index = neighbours.fit(df.withColumnRenamed("embedding", "vec"), 16, len(x), 10, coarse=9)
    assert len(index.coarse) == 9 and len(index.sizes) >= int(3000 ** 0.5) and index.sizes.sum() == 3000
    assert index.probes < len(index.sizes)
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, query_block=4, row_block=50, coarse=9).collect()
    assert len(found) == 1500 and check(found, x, ids, 10) >= 0.9


def test_pairs_of_many_queries_are_those_of_each():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((3000, 40)), rng.standard_normal((30, 40))
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    beat = np.sort(d, axis=1)[:, 9]
    qi, ri = neighbours.scan_pairs(np.ascontiguousarray(x.T), q, beat)
    pairs = set(zip(qi.tolist(), ri.tolist()))
    assert len(pairs) == len(qi) and all(d[a, b] <= beat[a] * (1 + 1e-6) for a, b in pairs)
    assert len(pairs) >= 0.95 * 300


def test_scan_abandons_but_keeps_the_nearest():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    d = ((x - q) ** 2).sum(1)
    kept = neighbours.scan(np.ascontiguousarray(x.T), q, float("inf"), 10)
    assert set(np.argsort(d)[:10].tolist()) <= set(kept.tolist()) and len(kept) < 50


def test_awkward_vectors(spark):
    v = [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0], None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [5.0, 5.0], [1.0, 2.0, 3.0], [float("inf"), 0.0], []]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)] + [(7, [5.0, 6.0], 1), (None, [1.0, 1.0], 2)],
                               "vec_id long, embedding array<double>, score int")
    found = sorted(map(tuple, neighbours.search(df, F.lit(True), k=3).collect()))
    assert [r[:3] for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (1, 1, 0), (1, 2, 2), (1, 3, 7), (2, 1, 0), (2, 2, 1), (2, 3, 7),
                                      (7, 1, 0), (7, 2, 1), (7, 3, 2)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
