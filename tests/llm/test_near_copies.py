"""The near-dedup stage against brute-force components of exact five-word Jaccard similarity."""

import random

import pytest
from llm_helpers import SF_SMALL, frame

from tilequarry.llm import simhash


def sets_by_hand(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def kept_by_hand(docs, similarity=0.8):
    """doc_ids that stay: the least of each component."""
    sets, label = sets_by_hand([t for _, t in docs]), list(range(len(docs)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x == sets[j] or common and common / (len(x) + len(sets[j]) - common) >= similarity:
                label[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[root(k)] = min(d, least.get(root(k), d))
    return sorted(least.values())


def graded(seed=3):
    """Pairs of texts at 0.75, 0.80 (just above and below), 0.82, 0.85 and 0.9, by the length of a replaced end; no word stands twice."""
    rng, docs, n = random.Random(seed), [], 0
    for k in range(90):
        length = rng.choice([13, 58, 104, 184, 304])
        words = [f"w{n + i}" for i in range(length)]
        n += 2 * length
        size, want = length - 4, [0.75, 0.80, 0.82, 0.85, 0.9][k % 5]
        most = int(size * (1 - want) / (1 + want)) + rng.choice([0, 0, 1])  # shingles lost
        docs += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:length - most] + [f"v{n + i}" for i in range(most)]))]
    return docs


@pytest.mark.parametrize("run_limit", [simhash.RUN_LIMIT, 3])
def test_every_pair_of_the_similarity_links_and_no_other(spark, run_limit):
    docs = graded()
    got = sorted(r.doc_id for r in simhash.keep_one(frame(spark, docs), run_limit=run_limit).collect())
    want = kept_by_hand(docs)
    assert 90 < len(want) < 180 and got == want


@pytest.mark.parametrize("run_limit", [simhash.RUN_LIMIT, 4])
def test_crowded_boilerplate(spark, run_limit):
    """Texts that share most of their words: chains, stars and pairs just too far apart under the same shingles."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for k in range(60):
        own = rng.choice([0, 6, 10, 14, 18, 22])
        start = rng.randrange(0, 121 - own)
        docs.append((k, " ".join(base[:start] + [f"x{k}y{i}" for i in range(own)] + base[start + own:])))
    docs += [(60, None), (61, ""), (62, "one two"), (63, "ONE two"), (64, "one two three")]
    got = sorted(r.doc_id for r in simhash.keep_one(frame(spark, docs), run_limit=run_limit).collect())
    assert got == kept_by_hand(docs)


def test_the_given_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert got == kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_shingles_of_crowded_counters_are_not_counted(spark):
    """All of them salted, or none: the classes are the same."""
    rows = [(k, " ".join(f"w{(k // 4) * 7 + j}" for j in range(60)) + f" x{k}") for k in range(40)] + [(100, "alone " * 9), (101, None)]
    found = []
    for crowded in (9, 255):
        classes = {}
        for r in simhash.near_copies(frame(spark, rows), 5, 0.8, crowded=crowded).collect():
            classes.setdefault(r.component, set()).add(r.oid)
        found.append(sorted(map(sorted, classes.values())))
    assert found[0] == found[1] and max(map(len, found[0])) == 4
