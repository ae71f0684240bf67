from collections import Counter

from llm_helpers import frame, same_as_sql
from pyspark.sql import functions as F

from tilequarry.llm import mixing

LEVELS = {"domain": "IF(doc_id < 100, 'a', 'b')", "lang": "CAST(doc_id % 2 AS STRING)"}


def test_query_against_sql(spark):
    same_as_sql(spark, "op6_mixing")


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", None, 50)], "d string, l string, available long")
    got = {(r.d, r.l): r.budget for r in mixing.budgets(leaves, ["d", "l"], {("a",): 1, ("b",): 1}, 400, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 150, ("b", None): 50}
    got = {(r.d, r.l): r.budget for r in mixing.budgets(leaves, ["d", "l"], {}, 2050, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 990, ("b", None): 50}  # a is full at 1010: the rest goes to b
    more = {(r.d, r.l): (r.budget, r.passes, r.remainder) for r in mixing.budgets(leaves, ["d", "l"], {}, 10**6, 3).collect()}
    assert more["a", "x"] == (30, 3, 0)


def test_prefixes_passes_and_awkward_rows(spark):
    docs = [(k, "one two three four five") for k in range(200)] + [(7, "one two three four five"), (None, "x y"), (5, None), (201, "")]
    taken = mixing.mix(frame(spark, docs), LEVELS, {}, 600, 2, seed=3, slice_digits=1)
    rows = taken.select(F.col("doc.doc_id").alias("id"), "domain", "lang", "n_tokens", "epoch").collect()
    by_leaf = Counter()
    for r in rows:
        by_leaf[r.domain, r.lang] += r.n_tokens
    # The document without an id is a leaf of its own, full at 4 tokens.
    assert all(0 <= {"a": 150, "b": 148}[leaf[0]] - n < 5 for leaf, n in by_leaf.items() if leaf[1] is not None)
    assert by_leaf["b", None] == 4
    again = mixing.mix(frame(spark, docs).repartition(7), LEVELS, {}, 600, 2, seed=3, slice_digits=3)
    key = lambda r: (r["doc"]["doc_id"] is not None, r["doc"]["doc_id"], r["epoch"])
    assert sorted(map(key, taken.collect())) == sorted(map(key, again.collect()))
    twice = mixing.mix(frame(spark, docs[:10]), {"d": "'all'"}, {}, 2.0, 2).groupBy("doc.doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}
    assert mixing.mix(frame(spark, docs).limit(0), LEVELS, {}, 1.0).count() == 0
    assert mixing.mix(frame(spark, docs), LEVELS, {}, 0).count() == 0


def test_equal_rows_at_the_cut_and_null_weights(spark):
    docs = [(1, "a b c")] * 7 + [(None, "x y")] * 5 + [(9, "p q r s")]
    for budget in range(0, 36):
        rows = mixing.mix(frame(spark, docs), {"d": "'all'"}, {}, budget, 1, seed=budget).select("doc.doc_id", "n_tokens").collect()
        left = 35 - sum(r.n_tokens for r in rows) if budget == 35 else budget - sum(r.n_tokens for r in rows)
        assert 0 <= left < 4 and len(rows) <= 13
    leaves = spark.createDataFrame([(None, 100), ("", 100), ("x", 100)], "d string, available long")
    got = {r.d: r.budget for r in mixing.budgets(leaves, ["d"], {(None,): 2, ("",): 1, ("x",): 1}, 120, 1).collect()}
    assert got == {None: 60, "": 30, "x": 30}


def test_prefix_is_that_of_the_sorted_rows(spark):
    import hashlib

    docs = [(k, "w " * (k % 7) + "end") for k in range(300)] + [(400, "long " * 5000)]
    rows = mixing.mix(frame(spark, docs), {"d": "'all'"}, {}, 700, 1, seed=5, slice_digits=1).select("doc.doc_id").collect()
    order = sorted((hashlib.md5(f"5:0:{d}".encode()).hexdigest(), d, len(t.split())) for d, t in docs)
    want, spent = [], 0
    for _, d, n in order:
        spent += n
        if spent > 700:
            break
        want.append(d)
    assert sorted(r.doc_id for r in rows) == sorted(want)


def test_blank_texts_around_the_cut(spark):
    """Texts without a word stand before and after the first that does not fit, in its slice."""
    import hashlib

    docs = [(k, "" if k % 3 else "w " * 5) for k in range(200)]
    rows = mixing.mix(frame(spark, docs), {"d": "'all'"}, {}, 152, 1, seed=2, slice_digits=0).select("doc.doc_id").collect()
    want, spent = [], 0
    for _, d, n in sorted((hashlib.md5(f"2:0:{d}".encode()).hexdigest(), d, len(t.split())) for d, t in docs):
        spent += n
        if spent > 152:
            break
        want.append(d)
    assert sorted(r.doc_id for r in rows) == sorted(want)


def test_plan_has_no_nested_loop_and_reads_texts_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = mixing.mix(docs, LEVELS, {}, 1.0, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Window" not in text
    assert text.count("text:string") == 1
