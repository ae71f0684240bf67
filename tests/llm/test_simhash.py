"""Fingerprints, links, components and near copies, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from llm_helpers import SF_SMALL, frame

from tilequarry.llm import simhash
from tilequarry.llm.components import components
from tilequarry.llm.queries import QUERIES


def fingerprint_by_hand(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(fps, radius):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(1)
        if (new == label).all():
            return label
        label = new


def check_classes(rows, docs):
    ids = sorted({d for d, _ in docs if d is not None})
    fps = {d: fingerprint_by_hand(t) for d, t in docs}
    label = classes_by_hand(np.array([fps[i] for i in ids], np.uint64), 3)
    for r in rows:
        assert r.fp % (1 << 64) == fps[r.doc_id]
        assert r.component_id == ids[label[ids.index(r.doc_id)]]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = QUERIES["op10_simhash_near_dedup"](spark, SF_SMALL).collect()
    assert {(r.doc_id, r.fingerprint) for r in rows} == {(d, "%016x" % fingerprint_by_hand(t)) for d, t in docs}


def test_awkward_documents(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") * 3 for _ in range(400)]
    docs = [(k, " ".join(base[:k * 5] + [str(k)] + base[k * 5:])) for k in range(30)]
    docs += [(31, None), (32, ""), (33, " \n"), (34, "One"), (35, "one"), (36, "one TWO"), (37, "x " * 20000)]
    rows = simhash.classes(frame(spark, docs + docs[:3])).collect()
    assert len(rows) == len(docs) + 3
    check_classes(rows, docs)
    null = simhash.classes(frame(spark, [(None, "a b c"), (5, "a b c"), (None, "z y x w")])).collect()
    assert sorted(str(r.component_id) for r in null) == ["5", "5", "None"]
    assert simhash.classes(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("radius,limit", [(3, 3), (3, 20000), (5, 7)])
def test_links_find_every_chain(spark, radius, limit):
    rng = random.Random(radius)
    seen = set()
    for _ in range(5):
        b = rng.getrandbits(64)
        seen.add(b)
        for _ in range(40):
            x = b
            for k in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3, 4])):
                x ^= 1 << k
            seen.add(x)
    fps = np.array(sorted(seen | {rng.getrandbits(64) for _ in range(150)}), np.uint64)
    place = {int(v): k for k, v in enumerate(fps.view(np.int64))}
    found = simhash.links(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long"), radius, limit).collect()
    label = simhash._join(np.arange(len(fps)), np.array([place[r.u] for r in found]), np.array([place[r.v] for r in found]))
    assert (label == classes_by_hand(fps, radius)).all()


def test_thresholds_cover_the_radius():
    for n in (100, 10**6, 10**10):
        for radius in (1, 3, 6):
            plan = simhash.plan_index(np.full((64, 64), n / 4) + np.eye(64) * n / 4, n, radius)
            assert sum(t + 1 for _, t in plan) == radius + 1
            bits = [b for part, _ in plan for b in part]
            assert len(bits) == len(set(bits))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 21: 20}


def test_near_copies_keep_one(spark):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    docs = []
    for k, t in enumerate(texts):
        docs.append((10 * k, " ".join(t)))
        if k < 6:
            edited = list(t)
            edited[150] = "other"
            docs += [(10 * k + 1, " ".join(edited)), (10 * k + 2, " ".join(t))]
    docs += [(0, docs[0][1])]
    kept = simhash.keep_one(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(12)]
    assert kept.columns == frame(spark, docs).columns


def test_crowded_keys_end_in_bounded_groups(spark, tmp_path, monkeypatch):
    """Fingerprints that stay under one key at every level: no task may pair off more than two blocks of a key."""
    rng, limit, folder = random.Random(6), 40, str(tmp_path)
    base = rng.getrandbits(16)
    fps = np.array(sorted({base | sum(1 << b for b in rng.sample(range(48, 64), rng.choice([1, 2, 3, 5, 7, 9]))) for _ in range(500)}), np.uint64)
    stream = simhash._stream

    def watched(batches, radius, run_limit, level):
        def noted():
            count = {}
            for b in batches:
                for k, n in b["key"].value_counts().items():
                    count[k] = count.get(k, 0) + n
                yield b
            most = max((n for n in count.values() if n <= run_limit), default=0)
            open(f"{folder}/{most}", "w").close()
        return stream(noted(), radius, run_limit, level)

    monkeypatch.setattr(simhash, "_stream", watched)
    place = {int(v): k for k, v in enumerate(fps.view(np.int64))}
    found = simhash.links(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long"), 3, limit).collect()
    label = simhash._join(np.arange(len(fps)), np.array([place[r.u] for r in found]), np.array([place[r.v] for r in found]))
    assert (label == classes_by_hand(fps, 3)).all()
    assert 0 < max(int(p.name) for p in tmp_path.iterdir()) <= 4 * limit
