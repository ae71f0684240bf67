from llm_helpers import frame, same_as_sql
from pyspark.sql import functions as F

from tilequarry.llm import quality


def test_query_against_sql(spark):
    same_as_sql(spark, "op7_quality_rules")


def test_measurements_of_awkward_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (4, "a b c a b c"), (None, "x\nx\ny\nx\n\n"), (5, "a " * 30000)]
    rows = quality.ledger(frame(spark, docs)).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_repeat_words", "n_dup_lines", "failed").collect()
    got = {(r.doc_id, r.n_words): (r.n_repeat_words, r.n_dup_lines, r.failed & 3) for r in rows}
    assert len(rows) == 7
    assert got == {(1, 0): (0, 0, 1), (2, 0): (0, 0, 1), (3, 0): (0, 0, 1), (4, 6): (6, 0, 3), (None, 4): (0, 2, 1), (5, 30000): (30000, 0, 2)}


def test_policies_and_ablations(spark):
    docs = [(1, " ".join(f"w{k}" for k in range(80))), (2, "few words"), (3, "same words here " * 40), (4, "# $ " * 30)]
    rows = quality.ledger(frame(spark, docs))
    kept = quality.keep(frame(spark, docs))
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == frame(spark, docs).columns
    table = {(r.policy, r.rule): (r.n_failed, r.n_only) for r in quality.ablations(rows).collect()}
    assert table["v1", "few_words"] == (1, 1) and table["v1", "repeated_words"] == (2, 2)
    assert table["v2", "repeated_words"][1] == 1  # document 4 fails other rules too
    assert quality.ledger(frame(spark, docs).limit(0)).count() == 0
