"""Toxic passages by maximum-scoring segment search.

Fitting, on labelled documents: words and their beginnings get log-odds between toxic and other
documents under Dirichlet priors (the features' shares in all labelled documents); those
that stand out by `MIN_Z` standard errors make the lexicon.  Every other word costs a little, so a text is a
sequence of scores with a negative mean, and one linear scan finds all its maximal
segments.  By extreme-value statistics a segment of score S in n words of ordinary text has
S * rate - log(K n) to its credit (natural log of odds against chance); rate and K are
fitted on the other documents.  Credits of all significant segments add up, and a logistic curve
over them, fitted on the labels, turns the sum into a score from 0 to 1.

Both classes are counted over all features in Spark, and log-odds and standard errors are columns
there.  What reaches the driver is the lexicon, which is every feature that passes and grows with the
vocabulary, and a histogram of word scores and one of credits, of fixed size.  The labelled texts are read twice, for the
counts and for their words' scores; these are stored (only those that are not 0), and rate, K and curve are fitted on them.

Defined results: null, empty and wordless texts have no segment and the least credit; a null
doc_id takes no part in fitting and is scored like any other; labels that repeat count again; without a toxic or without
another labelled document every score is 0; an empty table gives an empty result; all input columns are carried in `doc`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequarry.llm.common import row_struct, written

#: Least toxic documents that have a feature of the lexicon, standard errors it must stand out by.
MIN_DOCS, MIN_Z = 3, 3.0
#: Weight of the prior in features, and what each feature has at least.
PRIOR, LEAST = 500.0, 0.5
#: Lengths of word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bins of a credit and of a word score, and the range kept apart.
_BIN, _LOW, _HIGH = 0.25, -40.0, 400.0
_WORD = re.compile(r"[^\W\d_]+")
#: Latin-1 with a space for what is in no word.
_LETTERS = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))
_REMEMBERED = 300_000
#: Features a task counts before it hands the counts on.
_COUNTED = 200_000
_SCORED = "toxic long, n_words long, at array<int>, score array<double>"


def words(text: str) -> list[str]:
    """The words of a text in lower case; by table where Latin-1 can write it."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in BEGINNINGS if k < len(word))]


class Scores(dict[str, float]):
    """Score of each word met so far: the greatest of its features, 0 where the lexicon has none."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.heads = lexicon, {f[:BEGINNINGS[0]] for f in lexicon}

    def __missing__(self, word: str) -> float:
        found = 0.0
        if word[:BEGINNINGS[0]] in self.heads:  # all features of a word begin like it
            found = max((self.lexicon[f] for f in features(word) if f in self.lexicon), default=0.0)
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """The score of each word of a text."""
        found = words(text)
        out = np.fromiter(map(self.__getitem__, found), np.float64, len(found))
        if len(self) > _REMEMBERED:
            self.clear()
        return out


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    cost: float = 0.05  # of a word that is not in the lexicon
    rate: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float] = (-math.inf, 0.0)

    def segments(self, scores: np.ndarray) -> list[tuple[float, int, int]]:
        """All maximal scoring segments (score, first word, end), by one scan over the words that score.

        Each open segment knows the nearest earlier one with a lower left total, so the search jumps over
        those between, and every jump is made once: the scan is linear however the totals run.
        """
        at = np.flatnonzero(scores)
        open_: list[tuple[float, float, int, int, int]] = []  # left total, right total, first word, end, nearest lower
        total, before = 0.0, 0
        for i, s in zip(at.tolist(), scores[at].tolist()):
            left = total - self.cost * (i - before)
            total, first, before = left + s, i, i + 1
            j = len(open_) - 1
            while j >= 0:
                if open_[j][0] >= left:
                    j = open_[j][4]
                elif open_[j][1] >= total:
                    break
                else:  # the earlier one and all since then become one with this
                    left, _, first, _, back = open_[j]
                    del open_[j:]
                    j = back
            open_.append((left, total, first, before, j))
        return [(right - left, first, end) for left, right, first, end, _ in open_]

    def judged(self, scores: np.ndarray) -> tuple[float, list[tuple[float, int, int]]]:
        """Credit, and the segments with one above 0: credit, first word, end.

        The credit is the sum over these significant segments; without one, what the best falls short by.
        """
        found = self.segments(scores)
        if not found:
            return _LOW, []
        base = self.log_k + math.log(len(scores))
        credits = [(s * self.rate - base, a, b) for s, a, b in found]
        passages = [c for c in credits if c[0] > 0]
        return min(_HIGH, sum(c for c, _, _ in passages) or max(_LOW, max(credits)[0])), passages

    def probability(self, credit: float) -> float:
        a, b = self.curve
        x = a + b * credit
        return 0.0 if x < -700 else 1 / (1 + math.exp(-x))


# ---- fitting ------------------------------------------------------------------------

def _count(train: DataFrame) -> DataFrame:
    """feature, y1, y0: in how many toxic and other documents; the empty feature holds the sums over all features."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[pd.DataFrame]:
            every = list(c[0].keys() | c[1].keys())
            for a in range(0, len(every), 10_000):
                some = every[a:a + 10_000]
                yield pd.DataFrame({"feature": pd.Series(some, dtype=object), "y1": [c[1][f] for f in some], "y0": [c[0][f] for f in some]})

        c: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for b in batches:
            for t, toxic in zip(b["text"], b["toxic"]):
                found = set(words(t))
                c[toxic].update(found)
                c[toxic][""] += len(found)
                for k in BEGINNINGS:
                    starts = {w[:k] + "-" for w in found if len(w) > k}
                    c[toxic].update(starts)
                    c[toxic][""] += len(starts)
                if len(c[0]) + len(c[1]) > _COUNTED:
                    yield from rows()
                    c = (Counter(), Counter())
        yield from rows()

    rows = train.mapInPandas(count, "feature string, y1 long, y0 long")
    return rows.groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def _lexicon(train: DataFrame) -> dict[str, float]:
    counts = written(_count(train).where((F.col("y1") >= MIN_DOCS) | (F.col("feature") == "")), "counts")
    n1, n0 = next(iter(counts.where("feature = ''").select("y1", "y0").collect()), (0, 0))
    if not n1 or not n0:
        return {}
    y1, y0 = F.col("y1"), F.col("y0")
    prior = PRIOR * (y1 + y0) / (n1 + n0) + LEAST
    odds = F.log((y1 + prior) / (n1 + PRIOR - y1)) - F.log((y0 + prior) / (n0 + PRIOR - y0))
    scored = counts.where("feature <> ''").select("feature", odds.alias("odds"), F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)).alias("error"))
    return {r.feature: r.odds for r in scored.where(F.col("odds") / F.col("error") >= MIN_Z).select("feature", "odds").toLocalIterator()}


def _histogram(rows: DataFrame, by: list[str]) -> list:
    return rows.groupBy(*by).agg(F.sum("n").alias("n")).collect()


def _scored(train: DataFrame, model: Model) -> DataFrame:
    """toxic, n_words, and place and score of the words that have one, of each labelled document."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Scores(model.lexicon)
        for b in batches:
            out = []
            for t, toxic in zip(b["text"], b["toxic"]):
                s = memory.of(t)
                at = np.flatnonzero(s)
                out.append((toxic, len(s), at.astype(np.int32), s[at]))
            yield pd.DataFrame(out, columns=["toxic", "n_words", "at", "score"])

    return written(train.select("text", "toxic").mapInPandas(score, _SCORED), "scored")


def _word_histogram(scored: DataFrame) -> Counter[float]:
    """How often ordinary documents' words have each score (in tenths)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values, n = np.unique(np.rint(np.concatenate([np.empty(0), *b["score"]]) * 10).astype(int), return_counts=True)
            yield pd.DataFrame({"tenths": [0, *values], "n": [b["n_words"].sum() - n.sum(), *n]}, dtype=np.int64)

    rows = scored.where("toxic = 0").select("n_words", "score").mapInPandas(count, "tenths long, n long")
    return Counter({r.tenths / 10: r.n for r in _histogram(rows, ["tenths"])})


def _credits(scored: DataFrame, model: Model) -> list:
    """toxic, bin, n: labelled documents by credit in bins."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter[tuple] = Counter()
            for toxic, n, at, score in b[["toxic", "n_words", "at", "score"]].itertuples(index=False):
                scores = np.zeros(n)
                scores[at] = score
                c[int(toxic), round(model.judged(scores)[0] / _BIN)] += 1
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["toxic", "bin", "n"])

    return _histogram(scored.mapInPandas(count, "toxic long, bin long, n long"), ["toxic", "bin"])


def _rate(scores: Counter[float], cost: float) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 over ordinary words."""
    total = sum(scores.values())
    p = [(n / total, s if s > 0 else -cost) for s, n in scores.items()]
    value = lambda x: sum(q * math.exp(min(700.0, x * s)) for q, s in p) - 1
    if not any(s > 0 for _, s in p):
        return 1.0
    low, high = 1e-6, 1e-3
    while value(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(rows: list) -> tuple[float, float]:
    """Greatest likelihood by Newton's method over binned credits, with a little ridge."""
    x = np.array([max(-10.0, min(20.0, r.bin * _BIN)) for r in rows])
    y, n = np.array([float(r.toxic) for r in rows]), np.array([float(r.n) for r in rows])
    if not (n[y == 1].sum() and n[y == 0].sum()):
        return (-math.inf, 0.0)
    design, w = np.stack((np.ones_like(x), x), axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (y - p)) - 1e-3 * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """Model of labelled documents (text, label 0 or 1)."""
    train = written(labelled.where(labelled[label].isin(0, 1)).select(
        F.coalesce(labelled[text].cast("string"), F.lit("")).alias("text"), labelled[label].cast("long").alias("toxic")), "labelled", "zstd")
    model = Model(lexicon=_lexicon(train))
    if not model.lexicon:
        return model
    scored = _scored(train, model)
    scores = _word_histogram(scored)
    model.cost = max(0.02, 2 * sum(s * n for s, n in scores.items()) / max(1, sum(scores.values())))
    model.rate = _rate(scores, model.cost)
    # log K from the mean of what ordinary documents' best segments reach: mean credit is Euler's constant then.
    rows = _credits(scored, model)
    ordinary = [(r.bin * _BIN, r.n) for r in rows if r.toxic == 0 and r.bin * _BIN > _LOW]
    if ordinary:
        model.log_k = sum(x * n for x, n in ordinary) / sum(n for _, n in ordinary) - 0.5772
        rows = _credits(scored, model)
    model.curve = _logistic(rows)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc (all input columns), score, credit, passages (first word, end, ... of significant segments)."""
    rows = docs.select(row_struct(docs))

    @F.pandas_udf("score double, credit double, passages array<long>")
    def scores_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = Scores(model.lexicon)
        for b in batches:
            out = []
            for t in b:
                credit, passages = model.judged(memory.of(t))
                out.append((model.probability(credit), credit, [k for _, a, e in passages for k in (a, e)]))
            yield pd.DataFrame(out, columns=["score", "credit", "passages"])

    body = F.coalesce(F.col("doc").getField(text).cast("string"), F.lit(""))
    return rows.select("doc", scores_of(body).alias("r")).select("doc", "r.*")


def held_out(doc_id: Column) -> Column:
    """Rows that fitting must not see: crc32 of the id's text leaves no remainder by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
