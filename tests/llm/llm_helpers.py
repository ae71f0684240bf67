"""Awkward documents, and rows in a comparable order."""

import random

import duckdb

from tilequarry.llm.oracle import ORACLE
from tilequarry.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"

def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def awkward(seed=0, n=40, alphabet=("a", "b", "c", "dd", "é", "\n")):
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows and shared passages."""
    rng = random.Random(seed)
    docs = []
    for k in range(n):
        t = " ".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        if docs and rng.random() < 0.5:
            b = rng.choice(docs)[1] or ""
            t = t + " " + b[rng.randrange(len(b) + 1):] + "  \n" + t[:40]
        docs.append((rng.choice([None, k, k, k, k, 3]), t if rng.random() > 0.05 else None))
    return docs + [docs[0], docs[5], (70, "x " * 300), (70, "x " * 300), (71, "x" * 900), (72, ""), (73, " \t\n")]


def frame(spark, docs):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(d, t, 1, "z", 2.0, b"q", "s", "l") for d, t in docs],
                                 "doc_id long, text string, tk int, pos string, score double, ids binary, source string, lang string")


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    rel = con.execute(ORACLE[name])
    cols = [c[0] for c in rel.description]
    df = QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, ([r[c] for c in cols] for r in df.collect()))) == sorted(map(repr, map(list, rel.fetchall())))
