"""Phrase collocations against counting every phrase in Python."""

import re
from collections import Counter

from llm_helpers import awkward, frame, same_as_sql

from tilequarry.llm import collocations as col

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, longest, least, top, cover):
    f, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault((lang, k), Counter())[tuple(w[i:i + k])] += 1
    rows = []
    for lang in total:
        all_ = {p: c for k in range(1, longest + 1) for p, c in f.get((lang, k), {}).items()}
        found = {p: c for p, c in all_.items() if len(p) > 1 and c >= least}
        lost = {p[i:i + m] for p, c in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                if 100 * c >= cover * all_[p[i:i + m]]}
        scored = []
        for p, a in found.items():
            if p not in lost:
                cut = min((1000 * a * total[lang] // (all_[p[:j]] * all_[p[j:]]), j) for j in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), a, all_[p[:cut[1]]], all_[p[cut[1]:]]))
        rows += [(lang, k, p.decode(), a, l, r, total[lang], -s) for k, (s, _, p, a, l, r) in enumerate(sorted(scored)[:top], 1)]
    return rows


def check(spark, docs, **given):
    rows = spark.createDataFrame([(t, g, 1, 2, "x") for g, t in docs], "text string, lang string, n int, id int, word string")
    asked = {"longest": 5, "least": 3, "top": 50, "cover": 100, **given}
    found = [tuple(r[c] for c in COLUMNS) for r in col.collocations(rows, **asked).collect()]
    asked.pop("chunk_bytes", None), asked.pop("buckets", None)
    want = brute(docs, **asked)
    assert sorted(found) == sorted(want)
    return want


def test_awkward_texts(spark):
    docs = [(["en", None, "de", "und", ""][k % 5], t) for k, (_, t) in enumerate(awkward(4, 60, ("a", "B", "c", "dd", "É", "x.", "\ty;\x0bz", "a")))]
    assert check(spark, docs, least=4)
    assert check(spark, docs, chunk_bytes=300, buckets=7)
    assert check(spark, docs, chunk_bytes=300, longest=3, top=2, cover=60)


def test_repeated_words_overlap_and_borders_part(spark):
    docs = [("en", "a a a a. a a"), ("en", "b\tc,b c\nb"), (None, "b c"), ("en", "c b c B C!"), ("en", "x " * 3000), ("en", None)]
    want = check(spark, docs, least=2)
    assert ("en", "x x x x x") in {(r[0], r[2]) for r in want}
    assert check(spark, [("en", "no phrase"), (None, "")], least=2) == []
    assert col.collocations(frame(spark, [(1, "a b")]).limit(0)).count() == 0


def test_products_pass_64_bits(spark):
    from pyspark.sql import functions as F

    n = 10**12
    row = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in (("a", n), ("n", 9 * n), ("l", n + 7), ("r", n + 9))])
    got = row.select(col._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * n * 9 * n // ((n + 7) * (n + 9))


def test_query_against_sql(spark):
    same_as_sql(spark, "op11_phrase_collocations")
