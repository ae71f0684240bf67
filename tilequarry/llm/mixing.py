"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (say domain, language, source): each node's budget is
shared among its children by weight, and a child never gets more than what its leaves can
give in `max_epochs` passes.  What a child cannot use goes to its siblings by their
weights; only when all of them are full does it go back up, to the siblings of their parent.  Each
leaf then gives whole passes over its documents and, for what is left of its budget, the
prefix of a pass in an order that seed and pass number fix: the documents
whose running token total stays within it.

Three tables are written: narrow rows (leaf, id, tokens, row hash) of all documents, the leaves, and each leaf's cut-off, the
first place in its order that is no longer paid for.  The tree is worked level by level with windows over its nodes.
A cut-off is found by slice of the order first, with about as many slices as a slice has rows, so only the
one slice in which a leaf's budget ends is put in order, equal rows as one.  Then documents are
filtered where they are, by their leaf's cut-off; no text is moved.

Defined results: null levels are a value of their own, also where weights are given (None in a path); null and blank texts cost no
tokens and follow their pass; a null doc_id is ordered as an empty one, rows of equal id by their tokens and hash; repeated rows
are taken each on its own; an empty table or a budget of 0 gives an empty result; all input columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.llm.common import SPACE, Scratch, row_struct

#: Hexadecimal digits of the order that make a slice, at least; more if a leaf has over 16^(2 digits) rows.
SLICE_DIGITS = 2
#: What stands for a null in a path.
_NULL = chr(30)
_EXACT = "decimal(18,0)"


def word_count(text: Column) -> Column:
    """Words of a text, without building them: borders between white space and words."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")).cast("long")


def share(nodes: DataFrame, within: Sequence[str]) -> DataFrame:
    """Adds `budget` to nodes (capacity, weight, parent budget `b`): shares by weight, none above capacity.

    In the order of capacity for each unit of weight, the full nodes come first: a node is full if its capacity is at most its
    share of what the nodes before it leave.  Whole numbers throughout.
    """
    by = Window.partitionBy(*within).orderBy((F.col("capacity").cast("double") / F.col("weight").cast("double")), "path")
    all_ = Window.partitionBy(*within)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumns({
        "left": F.col("b") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "rest": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    out = out.withColumns({c: F.col(c).cast(_EXACT) for c in ("left", "rest", "capacity", "weight")})
    out = out.withColumn("full", F.expr("capacity * rest <= weight * left"))
    out = out.withColumns({
        "used": F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(all_), F.lit(0)).cast(_EXACT),
        "open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_), F.lit(0)).cast(_EXACT)})
    budget = F.when(F.col("full"), F.col("capacity").cast("long")).otherwise(
        F.expr("(weight * CAST(b - used AS decimal(18,0))) div open"))
    return out.withColumn("budget", budget)


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], budget: int | float,
            max_epochs: int) -> DataFrame:
    """levels, available, budget, passes, remainder for leaves (levels, available).

    weights: a path from the root to its weight among its siblings; 1 where not given.
    A budget of type float is a share of all tokens there are.
    """
    spark = leaves.sparkSession
    rows = [(chr(31).join(_NULL if p is None else str(p) for p in path), int(w)) for path, w in weights.items()]
    given = spark.createDataFrame(rows or [("\0", 1)], "path string, given long")
    capacity = leaves.withColumn("capacity", F.col("available") * max_epochs)
    if isinstance(budget, float):
        budget = leaves.agg(F.floor(F.sum("available") * F.lit(budget))).first()[0] or 0
    parent = None
    for k in range(len(levels)):
        own, above = list(levels[:k + 1]), list(levels[:k])
        nodes = capacity.groupBy(*own).agg(F.sum("capacity").cast(_EXACT).alias("capacity")).withColumn(
            "path", F.concat_ws(chr(31), *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in own]))
        nodes = nodes.join(given, "path", "left").withColumn("weight", F.coalesce("given", F.lit(1)).cast(_EXACT)).drop("given")
        if k:
            up = parent.select(*[F.col(c).alias(f"up_{c}") for c in above], F.col("budget").alias("b"))
            nodes = nodes.join(up, [nodes[c].eqNullSafe(up[f"up_{c}"]) for c in above]).drop(*[f"up_{c}" for c in above])
        else:
            nodes = nodes.withColumns({"b": F.lit(int(budget)).cast(_EXACT), "root": F.lit(0)})
        parent = share(nodes, above or ["root"]).select(*own, F.col("budget").cast(_EXACT).alias("budget"))
    up = parent.select(*[F.col(c).alias(f"up_{c}") for c in levels], F.col("budget").cast("long").alias("budget"))
    found = leaves.join(up, [leaves[c].eqNullSafe(up[f"up_{c}"]) for c in levels]).drop(*[f"up_{c}" for c in levels])
    return found.withColumns({
        "passes": F.expr("IF(available = 0, 0, budget div available)"),
        "remainder": F.expr("IF(available = 0, 0, budget % available)")})


def _matching(rows: DataFrame, plan: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows joined with the plan of their leaf."""
    up = plan.select(*[F.col(c).alias(f"up_{c}") if c in names else F.col(c) for c in plan.columns])
    return rows.join(up, [rows[c].eqNullSafe(up[f"up_{c}"]) for c in names]).drop(*[f"up_{c}" for c in names])


def cut_offs(narrow: DataFrame, plan: DataFrame, names: Sequence[str], seed: int) -> DataFrame:
    """names, passes, remainder, cut (order, id, n_tokens, h) and quota: where each leaf's last pass ends.

    Rows before `cut` are paid for, and `quota` of those equal to it; a leaf without a remainder has no cut.
    """
    keyed = _matching(narrow, plan.where("remainder > 0"), names).withColumn("order", _order(seed))
    keyed = keyed.withColumn("slice", F.expr("substring(order, 1, digits)"))
    sums = keyed.groupBy(*names, "slice", "remainder").agg(F.sum("n_tokens").alias("tokens"))
    by_slice = Window.partitionBy(*names).orderBy("slice")
    ends = sums.withColumn("upto", F.sum("tokens").over(by_slice)).where("upto > remainder AND upto - tokens <= remainder")
    ends = ends.select(*names, "slice", (F.col("remainder") - F.col("upto") + F.col("tokens")).alias("left"))
    last = _matching(keyed.withColumnRenamed("slice", "own"), ends, names).where("own = slice")
    # Equal rows as one, so that a document given very often is one row here.
    equal = last.groupBy(*names, "left", "order", "id", "n_tokens", "h").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*names).orderBy("order", "id", "n_tokens", "h")
    equal = equal.withColumn("upto", F.sum(F.col("n_tokens") * F.col("n")).over(within))
    # The first that does not fit, which has tokens; before it, everything does.
    over = equal.where("upto > left").groupBy(*names).agg(F.min(F.struct("order", "id", "n_tokens", "h", "n", "upto", "left")).alias("cut"))
    return _matching_left(plan, over, names).select(
        *names, "passes", "remainder", F.expr("IF(cut IS NULL, NULL, struct(cut.order, cut.id, cut.n_tokens, cut.h))").alias("cut"),
        F.coalesce(F.expr("(cut.left - (cut.upto - cut.n_tokens * cut.n)) div cut.n_tokens"), F.lit(0)).cast("long").alias("quota"))


def _matching_left(plan: DataFrame, over: DataFrame, names: Sequence[str]) -> DataFrame:
    up = over.select(*[F.col(c).alias(f"up_{c}") for c in names], "cut")
    return plan.join(up, [plan[c].eqNullSafe(up[f"up_{c}"]) for c in names], "left")


def _order(seed: int) -> Column:
    """Place of a document in its leaf's last pass, as hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes").cast("string"), "id").cast("binary"))


def mix(docs: DataFrame, levels: Mapping[str, str], weights: Mapping[tuple, int], budget: int | float, max_epochs: int = 1,
        seed: int = 0, text: str = "text", key: str = "doc_id", slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """doc (all input columns), the levels, n_tokens and epoch: a row for each time a document is taken.

    levels: names from the root down, with SQL expressions over docs.
    """
    names, scratch = list(levels), Scratch(docs.sparkSession)
    own = [F.expr(c).cast("string").alias(n) for n, c in levels.items()]
    ident = F.coalesce(docs[key].cast("string"), F.lit("")).alias("id")
    row_hash = F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns]).alias("h")
    narrow = scratch.written(docs.select(*own, ident, row_hash, word_count(docs[text]).alias("n_tokens")), "mixed")
    leaves = scratch.written(narrow.groupBy(*names).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_rows")), "leaves")
    digits = F.greatest(F.lit(slice_digits), F.ceil(F.log(16.0, F.sqrt("n_rows")))).cast("int").alias("digits")
    plan = budgets(leaves, names, weights, budget, max_epochs).select(*names, "passes", "remainder", digits)
    cuts = scratch.written(cut_offs(narrow, scratch.written(plan, "plan"), names, seed), "cuts")
    scratch.drop(narrow)
    one = docs.select(row_struct(docs), *own, ident, row_hash, word_count(docs[text]).alias("n_tokens"))
    dealt = _matching(one, cuts.where("passes > 0 OR remainder > 0"), names).withColumn("order", _order(seed))
    place = F.struct("order", "id", "n_tokens", "h")
    times = F.col("passes") + F.when(place < F.col("cut"), 1).otherwise(0)
    taken = dealt.select("doc", *names, "n_tokens", F.explode(
        F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))).alias("epoch"))
    if cuts.where("quota > 0").isEmpty():
        return taken
    # Some of several equal rows: one of them, as often as is paid for.
    some = dealt.where("quota > 0").where(place == F.col("cut")).groupBy(*names, "n_tokens", "passes", "quota").agg(F.any_value("doc").alias("doc"))
    return taken.unionAll(some.select("doc", *names, "n_tokens", F.explode(F.array_repeat("passes", F.col("quota").cast("int"))).alias("epoch")))
