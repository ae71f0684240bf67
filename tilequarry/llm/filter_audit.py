"""Filter interaction audit by a Gray-code walk over all subsets of filters.

Every filter is judged once per document and leaves a bit; documents with equal bits in the
same part become one cell.  For each part the 2^k subsets of active filters are walked in Gray-code order, which
turns one filter on or off at a time: each cell keeps the number of active filters it fails, and running
totals hold the documents whose number is 0.  The totals of each subset are stored, so what a filter removes at
any step of any order is the difference of two stored states; no order is run over the documents.

How the work is dealt: texts leave their task as bits and a digest.  Whether a text also stands under a smaller
doc_id is decided on groups of equal (digest, part, labels), summed before the exchange, so a text that a third of
all rows share sends one row per task.  A part then has at most 2^k cells.

Defined results: a null or empty text has no words and no code points and counts as a text equal to other empty
ones; a null part is the empty string; a null doc_id is smaller than none and larger than none, so its row is never a
duplicate and makes none; rows with the same doc_id and text are no duplicates of each other, each counts; a document
without labels is neither good nor toxic, one with several is what any of them says; an empty table gives no rows;
further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.llm.common import words

#: Condition, over the measurements of a text, under which it fails; the position is the bit.
CONDITIONS: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_points",
    "D": "has_symbol",
}
#: The filter that asks for the other documents; its bit is the last.
COPIES = "E"
MEASURES = ("n", "good", "toxic")
STEPS = """part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,
good_lost long, toxic_lost long, shapley long"""


def measure(docs: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, part, digest and the measurements the conditions speak of."""
    one = docs.select(docs[key].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
                      F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    split = one.select("id", "part", "t", words(F.col("t")).alias("w"))
    return split.select(
        "id", "part", F.unhex(F.sha2("t", 256)).alias("digest"),
        F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.length("t").cast("long").alias("n_points"), F.col("t").rlike(r"[#$%&*|]").alias("has_symbol"))


def cells(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, str] = CONDITIONS, part: str = "lang",
          text: str = "text", key: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail; the bit after the conditions' is that of copies."""
    bits = " | ".join(f"IF({c}, {1 << k}, 0)" for k, c in enumerate(conditions.values())) or "0"
    failed = measure(docs, part, text, key).select("id", "part", "digest", F.expr(bits).alias("mask"))
    marks = labels.groupBy(labels[key].alias("id")).agg(
        F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    # Labels grow with the documents, so the two are merged, never broadcast.
    rows = failed.join(marks.hint("merge"), "id", "left").select(
        "id", "part", "digest", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    group = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("id", *group).agg(F.count("*").alias("n"))
    equal = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"),
                                      F.sum(F.expr("IF(id IS NULL, n, 0L)")).alias("n_null"))
    least = equal.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    split = least.withColumn("originals", F.expr("n_null + IF(first = least, n_first, 0L)")).withColumn(
        "originals", F.expr("coalesce(originals, n_null)"))
    both = split.selectExpr("part", "good", "toxic", f"""inline(array(
        struct(mask AS mask, originals AS n), struct(mask | {1 << len(conditions)} AS mask, n - originals AS n)))""")
    return both.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def walk(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors (one row of measures for each subset of active filters) of cells with their failure masks and measures."""
    failures = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    states = np.zeros((1 << k, counts.shape[1]), counts.dtype)
    active = 0
    states[0] = running
    for turn in range(1, 1 << k):
        bit = (turn & -turn).bit_length() - 1
        on = not active >> bit & 1
        active ^= 1 << bit
        hit = masks >> bit & 1 == 1
        before = failures == 0
        failures[hit] += 1 if on else -1
        changed = counts[hit & (before != (failures == 0))].sum(axis=0)
        running = running - changed if on else running + changed
        states[active] = running
    return states


def steps(part: str, states: np.ndarray, names: Sequence[str]) -> pd.DataFrame:
    """One row for each order of the filters and step, from the stored states."""
    k, full = len(names), len(states) - 1
    failing = [int(states[0, 0] - states[1 << f, 0]) for f in range(k)]
    only = [int(states[full ^ 1 << f, 0] - states[full, 0]) for f in range(k)]
    rows, total = [], [0] * k
    for order in permutations(range(k)):
        active = 0
        for step, f in enumerate(order, 1):
            lost = states[active] - states[active | 1 << f]
            active |= 1 << f
            removed = int(lost[0])
            total[f] += removed
            rows.append((part, "".join(names[g] for g in order), step, int(states[active, 0]), removed, failing[f] - removed,
                         only[f], int(lost[1]), int(lost[2]), f))
    out = pd.DataFrame(rows, columns=[*(c.split()[0] for c in STEPS.split(",")[:-1]), "f"])
    return out.assign(shapley=[total[f] for f in out["f"]]).drop(columns="f")


def audit(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """STEPS of cells (part, mask, n, good, toxic): every order of the filters, every step, per part."""
    names = list(names)

    def of_part(frame: pd.DataFrame) -> pd.DataFrame:
        states = walk(frame["mask"].to_numpy(np.int64), frame[list(MEASURES)].to_numpy(np.int64), len(names))
        return steps(frame["part"].iloc[0], states, names)

    return found.groupBy("part").applyInPandas(of_part, STEPS)


def interactions(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, str] = CONDITIONS, part: str = "lang") -> DataFrame:
    """The audit of `conditions` and copies over documents."""
    return audit(cells(docs, labels, conditions, part), [*conditions, COPIES])
