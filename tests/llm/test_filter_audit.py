"""The filter audit against running every order over the documents."""

import re
from itertools import permutations

import numpy as np
from llm_helpers import awkward, frame, same_as_sql

from tilequarry.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int, lang string, n int"


def failures(docs):
    first = {}
    for d, t in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append("".join(f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            re.search(r"[#$%&*|]", t), d is not None and d > first[t])) if bad))
    return out


def brute(parts, fails, good, toxic):
    rows = {}
    for part in set(parts):
        mine = [k for k, p in enumerate(parts) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                out = {k for k in left if f in fails[k]}
                left -= out
                shapley[f] += len(out)
                rows[part, "".join(order), step] = [len(left), len(out), sum(f in fails[k] for k in mine) - len(out),
                                                    sum(fails[k] == f for k in mine), sum(good[k] for k in out), sum(toxic[k] for k in out), f]
        for (p, _, _), r in rows.items():
            if p == part:
                r[6] = shapley[r[6]]
    return rows


def test_awkward_documents(spark):
    docs = awkward(8, 60, ("a", "B", "#", "dd", "é", "\n", "w1", "w2", "w3")) + [(80 + k, "Aa " * 250) for k in range(6)] + [(200, "long " * 40000)]
    docs += [(90 + k, " ".join(f"u{j}" for j in range(210))) for k in range(3)]
    marks = [(d, k % 3 == 0, k % 2) for k, d in enumerate(dict.fromkeys(d for d, _ in docs if d is not None))]
    labels = spark.createDataFrame([(d, int(g), t, "zz", 5) for d, g, t in marks] + [(None, 1, 1, None, 1), (3, 1, None, None, 1)], LABELS)
    parts = [[None, "en", "", "de"][hash(t) % 4] for _, t in docs]
    rows = spark.createDataFrame([(d, t, p, 7, "q") for (d, t), p in zip(docs, parts)], "doc_id long, text string, lang string, mask int, part string")
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
             for r in fa.interactions(rows, labels).collect()}
    good = {d: g for d, g, _ in marks} | {3: True}
    toxic = {d: t for d, _, t in marks}
    want = brute([p or "" for p in parts], failures(docs), [bool(good.get(d)) for d, _ in docs], [bool(toxic.get(d)) for d, _ in docs])
    assert found == want and len(found) % 600 == 0


def test_walk_is_every_subset():
    rng = np.random.default_rng(3)
    masks, counts = np.arange(32), rng.integers(0, 50, (32, 3))
    states = fa.walk(masks, counts, 5)
    for active in range(32):
        assert (states[active] == counts[masks & active == 0].sum(axis=0)).all()


def test_other_conditions_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b"), (2, "a b"), (3, "c")])
    labels = spark.createDataFrame([], LABELS)
    rows = fa.interactions(docs, labels, {"S": "n_words < 2"}).orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed) for r in rows] == [("ES", 1, 2, 1), ("ES", 2, 1, 1), ("SE", 1, 2, 1), ("SE", 2, 1, 1)]
    assert fa.interactions(docs.limit(0), labels).count() == 0


def test_query_against_sql(spark):
    same_as_sql(spark, "op12_filter_audit")
