import math
import random
import time
import zlib

import numpy as np
from llm_helpers import frame

from tilequarry.llm import toxicity
from tilequarry.llm.queries import QUERIES


def segments_by_hand(v):
    """Maximal segments: the best stretch (of equal ones the shortest), then the same to its left and right."""
    def rec(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += v[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12 or total > best[0] - 1e-12 and j + 1 - i < best[2] - best[1]):
                    best = (total, i, j + 1)
        return [] if best is None else rec(a, best[1]) + [best] + rec(best[2], b)
    return rec(0, len(v))


def test_all_maximal_segments():
    rng, model = random.Random(1), toxicity.Model(cost=1.0)
    for _ in range(200):
        s = np.array([rng.choice([0, 0, 0, 1.5, 3, 0.7]) for _ in range(rng.randrange(0, 25))])
        got, want = model.segments(s), segments_by_hand([x if x > 0 else -1.0 for x in s])
        assert len(got) == len(want) and np.allclose([g[0] for g in got], [w[0] for w in want])


def test_segments_take_linear_time():
    model = toxicity.Model(cost=3.0)
    runs = {"falls": np.tile([1.0, 0.0], 100_000), "rises": np.full(200_000, 1.0),
            "falls, then rises": np.concatenate((np.tile([1.0, 0.0], 50_000), np.full(100_000, 1.0)))}
    for name, scores in runs.items():
        begun = time.process_time()
        found = model.segments(scores)
        assert time.process_time() - begun < 5, name
        assert len(found) == {"falls": 100_000, "rises": 1, "falls, then rises": 50_001}[name]


def test_scores_are_what_the_definition_gives(spark):
    """Credits and scores of a fitted model, worked out from its parts on each text."""
    rng = random.Random(5)
    word = lambda: rng.choice(["foul", "vile", "rude"] if rng.random() < 0.012 else [f"word{chr(97 + k)}" for k in range(20)])
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 120)))) for k in range(400)]
    train = frame(spark, docs).selectExpr("text", "IF(text RLIKE 'foul|vile', 1, 0) AS toxic")
    model = toxicity.fit(train)
    assert model.lexicon
    for r in toxicity.score(frame(spark, docs), model).select("doc.doc_id", "score", "credit", "passages").collect():
        words = dict(docs)[r.doc_id].split()
        known = [max([model.lexicon.get(f, 0.0) for f in toxicity.features(w)]) for w in words]
        found = segments_by_hand([x if x > 0 else -model.cost for x in known])
        credits = [s * model.rate - model.log_k - math.log(len(words)) for s, _, _ in found]
        want = toxicity._LOW if not credits else min(toxicity._HIGH, sum(c for c in credits if c > 0) or max(toxicity._LOW, max(credits)))
        assert abs(r.credit - want) < 1e-6
        assert abs(r.score - 1 / (1 + math.exp(-model.curve[0] - model.curve[1] * want))) < 1e-9
        assert r.passages == [p for c, (_, a, b) in zip(credits, found) if c > 0 for p in (a, b)]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    seen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in seen) / len(seen) > 0.9


def test_passages_and_awkward_texts(spark):
    rng = random.Random(2)
    plain = lambda n: [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)]
    docs = []
    for k in range(300):
        text = plain(80)
        if k % 4 == 0:
            text[40:43] = ["vile", "rotten", "vile"]
        docs.append((k, " ".join(text)))
    train = frame(spark, docs).selectExpr("text", "IF(doc_id % 4 = 0, 1, 0) AS toxic")
    model = toxicity.fit(train)
    found = toxicity.score(frame(spark, docs + [(300, None), (301, ""), (None, "9 9 ..."), (0, docs[0][1])]), model).select(
        "doc.doc_id", "score", "passages").collect()
    assert len(found) == 304
    for r in found:
        toxic = r.doc_id is not None and r.doc_id < 300 and r.doc_id % 4 == 0
        assert (r.score >= 0.5) == toxic
        assert not toxic or r.passages[0] == 40 and r.passages[1] == 43
    nothing = toxicity.fit(train.where("toxic = 0"))
    assert {r.score for r in toxicity.score(frame(spark, docs[:3]), nothing).collect()} == {0.0}
    assert toxicity.score(frame(spark, docs).limit(0), model).count() == 0


def test_rare_toxic_words_are_found_beside_any_number_of_ordinary_ones(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxy", k=10))
    common = [name() for _ in range(30000)]  # more than 131,072 features
    assert len({f for w in common for f in toxicity.features(w)}) > 1 << 17
    rows = [(k, " ".join(common) + (" zzvile" if k else ""), 1) for k in range(8)]
    rows += [(8 + k, " ".join(name() for _ in range(30000)), 0) for k in range(50)]
    lexicon = toxicity._lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic long").select("text", "toxic"))
    assert "zzvile" in lexicon


def test_words_by_table_are_those_of_the_rule():
    rng = random.Random(7)
    signs = [chr(c) for c in range(0x300)] + list("Σςǅİ²½١_ﬁ𝐀汉字́ Å")
    texts = ["".join(rng.choices(signs[:top], k=rng.randrange(0, 60))) for top in (128, 256, len(signs)) for _ in range(500)]
    for t in [*texts, "".join(signs), "".join(signs[:256]), "", " \x85\xa0\x1c"]:
        assert toxicity.words(t) == toxicity._WORD.findall(t.lower())


def test_rate_and_curve_are_fitted_on_stored_scores(spark, monkeypatch):
    """The labelled texts are split into words for the counts and for the scores, and not again."""
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice("abcdefgh") * 5 for _ in range(30)) + (" gemein ЗЛО" if k % 3 == 0 else " gemein" if k % 10 == 1 else ""))
            for k in range(120)]
    train = frame(spark, docs + [(0, None), (1, ""), (2, "1 2 _")]).selectExpr("text", "IF(text RLIKE 'ЗЛО', 1, 0) AS toxic")
    given = []
    for name in ("_word_histogram", "_credits"):
        monkeypatch.setattr(toxicity, name, lambda df, *a, f=getattr(toxicity, name): given.append(df) or f(df, *a))
    model = toxicity.fit(train)
    assert {"gemein", "зло"} <= set(model.lexicon)
    assert len(given) == 3 and all("text" not in df.columns for df in given)
    found = {r.doc_id: r.score for r in toxicity.score(frame(spark, docs), model).select("doc.doc_id", "score").collect()}
    assert all((s >= 0.5) == (k % 3 == 0) for k, s in found.items())
    # Every word of ordinary documents is in the histogram, those without a score too.
    ordinary = [t for k, t in docs if k % 3] + ["1 2 _"]
    assert sum(toxicity._word_histogram(given[0]).values()) == sum(len(toxicity.words(t)) for t in ordinary)
    assert sum(r.n for r in toxicity._credits(given[0], model)) == len(docs) + 3
