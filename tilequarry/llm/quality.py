"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one bit; the measurements stay
beside it.  A policy is a versioned mask over those bits, so changing a policy, or
asking what a rule alone costs, needs no second look at the texts.

Defined results: a null or blank text has no words and fails FEW_WORDS; a null doc_id
is carried through; repeated rows are judged alike, each on its own; an empty table
gives an empty ledger; columns of the input, whatever their names, are kept in `doc`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.llm.common import SPACE, WORD, row_struct, words

#: Rule name and the condition, over the measurements, under which a document fails it.
#: The position is the bit; append only, so that stored ledgers stay readable.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES: dict[str, int] = {
    "v1": BIT["few_words"] | BIT["repeated_words"],
    "v2": sum(BIT.values()),
}
BASE = POLICIES["v1"]

#: Words of a window whose repetition counts.
WINDOW = 3


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (all input columns), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows are compared by a 64-bit hash of their words within one document, then
    sorted with their positions, so the cost is n log n in the longest text.
    """
    w, h, s, p = (F.col(c) for c in ("w", "h", "s", "p"))
    last = F.size(w) - WINDOW
    one = docs.select(row_struct(docs), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    split = one.select("doc", "t", words(F.col("t")).alias("w"),
                       F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    hashed = split.select(
        "doc", F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).alias("h"))
    keep = ["doc", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # Only documents in which some window repeats need the positions.
    ordered = hashed.select(*keep, F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
    starts = ordered.select(*keep, F.sort_array(F.transform(
        F.filter(s, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, k - 1))), lambda x: x["i"])).alias("p"))
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return starts.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """measure() and `failed`: one bit for each rule the document fails."""
    bits = " | ".join(f"IF({rule}, {1 << k}L, 0L)" for k, (_, rule) in enumerate(RULES))
    return measure(docs, text).withColumn("failed", F.expr(bits))


def passes(policy: str | int, failed: Column | None = None) -> Column:
    """Whether a ledger row is kept under a policy, by name or by mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(mask)) == 0


def keep(docs: DataFrame, policy: str | int = "v2", text: str = "text") -> DataFrame:
    """The documents a policy keeps, with the columns they came with."""
    # stack() keeps the filter above the ledger: pushed below, it would work the rules out again, nested.
    rows = ledger(docs, text).select(F.expr("stack(1, doc, failed) AS (doc, failed)"))
    kept = rows.where(passes(policy))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """policy, rule, n_failed, n_only: what each rule rejects, and what it alone rejects.

    One pass over a ledger; every figure is a sum of bit tests, so partial sums leave
    each task and a single row comes together.
    """
    policies = POLICIES if policies is None else policies
    asked = [(p, mask, name, BIT[name]) for p, mask in policies.items() for name in BIT if mask & BIT[name]]
    failed = F.col("failed")
    sums = [F.sum(test.cast("long")).alias(f"c{k}_{j}")
            for k, (_, mask, _, bit) in enumerate(asked)
            for j, test in enumerate((failed.bitwiseAND(F.lit(bit)) != 0, failed.bitwiseAND(F.lit(mask)) == bit))]
    out = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"),
                             F.coalesce(f"c{k}_0", F.lit(0)).alias("n_failed"),
                             F.coalesce(f"c{k}_1", F.lit(0)).alias("n_only"))
                    for k, (p, _, name, _) in enumerate(asked)])
    return rows.agg(*sums).select(F.explode(out).alias("r")).select("r.*")
