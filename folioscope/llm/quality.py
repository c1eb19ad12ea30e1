"""Operator 4: a quality classifier made of a sparse ensemble of rules.

Statistics of each whole text are native column expressions. Boosted trees of depth DEPTH are grown on a bounded sample of labelled
documents; each path from a root to a node is a conjunctive rule over statistics; lasso logistic regression (FISTA,
weights kept sparse by its soft threshold) gives the rules weights; rules with weight compile into one Spark expression, so scoring is
a projection without a shuffle.

The sample is the `sample` labelled rows of least hash of doc_id (SAMPLE; a parameter): only their statistics reach the
driver. A doc_id with several labels counts by their mean, one with several texts by that of least hash; null labels and labels without a document are left out. Without labels, or
with one class alone, the score is the share of label 1 (0.5 without labels). Null texts count as empty and get a score like
any other; repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SAMPLE = 20_000
TREES, DEPTH, RATE, LEAF = 24, 3, 0.3, 10
PENALTY = 0.002
STEPS = 400
QUANTILES = 48


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where expressions are pushed through projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _counts(t: Column) -> dict[str, Column]:
    """What passes over the text, each once."""
    count = lambda p: F.regexp_count(t, F.lit(p))
    return {
        "chars": F.length(t), "words": count(WORD), "blanks": count(r"[\x20\x09-\x0D]"), "lines": count("\n") + 1, "upper": count(r"\p{Lu}"), "digits": count("[0-9]"),
        "symbols": count(r"[#$%&*@^~|<>{}\[\]_=+\\]"), "pipes": count(r"\|"), "shouts": count("[!?]"), "stops": count("[.,;:]"),
        "short": count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])"),
        "distinct": F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+"))), "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))),
    }


def statistics(text: Column) -> Column:
    """Struct of the statistics NAMES of a text (null: empty), all finite doubles."""

    def of(c: Column) -> Column:
        n, w, lines = F.greatest(c["chars"], F.lit(1)).cast("double"), F.greatest(c["words"], F.lit(1)).cast("double"), c["lines"]
        values = (
            F.log1p(c["chars"].cast("double")), F.log1p(c["words"].cast("double")), (n - c["blanks"]) / w, c["upper"] / n, c["digits"] / n, c["symbols"] / n, c["pipes"] / w, c["shouts"] / w, c["stops"] / w, c["short"] / w, c["words"] / lines,
            F.log1p(c["distinct"].cast("double")) / F.log1p(w + 1),  # hardly depends on length
            c["distinct_lines"] / lines,
        )
        return F.struct(*(v.cast("double").alias(k) for k, v in zip(NAMES, values, strict=True)))

    return _let(F.struct(*(v.alias(k) for k, v in _counts(F.coalesce(text.cast("string"), F.lit(""))).items())), of)


NAMES = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "pipes", "shouts", "stops", "short_words", "words_in_line", "distinct_words", "distinct_lines")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, at most?, threshold) hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, low, t in self.tests:
            out &= x[:, j] <= t if low else x[:, j] > t
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for j, low, t in self.tests:
            c = stats[NAMES[j]]
            out = out & (c <= t if low else c > t)
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, text: Column) -> Column:
        """Score of a text. The statistics are bound once, so a filter on the score doesn't compute them for each rule again."""

        def compiled(stats: Column) -> Column:
            z = F.lit(float(self.bias))
            for rule, weight in self.rules:
                z = z + F.when(rule.column(stats), float(weight)).otherwise(0.0)
            return 1 / (1 + F.exp(-z))

        return _let(statistics(text), compiled)


def _split(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
    """The statistic and threshold of largest gain."""
    best, found = 1e-9, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        size = len(edges) + 1
        c = codes[rows, j]
        n, gs, hs = np.bincount(c, minlength=size)[:-1].cumsum(), np.bincount(c, g[rows], size)[:-1].cumsum(), np.bincount(c, h[rows], size)[:-1].cumsum()
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
        if (k := int(gain.argmax())) >= 0 and gain[k] > best:
            best, found = gain[k], (j, float(edges[k]))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, without repeats."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, QUANTILES + 2)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        todo = [((), np.arange(len(y)), 0)]
        while todo:
            tests, rows, depth = todo.pop()
            cut = _split(x, codes, cuts, rows, g, h) if depth < DEPTH else None
            if tests:
                rules[Rule(tuple(sorted(tests)))] = None
            if cut is None:
                z[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
                continue
            j, t = cut
            low = x[rows, j] <= t
            todo += [((*tests, (j, True, t)), rows[low], depth + 1), ((*tests, (j, False, t)), rows[~low], depth + 1)]
    return list(rules)


def lasso(features: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias and weights of L1-penalised logistic regression, by accelerated proximal gradient steps."""
    n, k = features.shape
    a = np.concatenate([np.ones((n, 1)), features], axis=1)
    v = np.ones(k + 1)
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / (np.linalg.norm(a @ v) ** 2 * 1.02)
    w = last = np.zeros(k + 1)
    for i in range(steps):
        at = w + i / (i + 3) * (w - last)
        z = at - step * (a.T @ (1 / (1 + np.exp(-a @ at)) - y)) / n
        z[1:] = np.sign(z[1:]) * np.maximum(np.abs(z[1:]) - step * penalty, 0)
        last, w = w, z
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0)
    if y.min() == y.max():
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))))
    bias, weights = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64), y)
    return Model(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled documents that aren't held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` small rows, so they may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # of several texts of one doc_id the one of least hash
    got = rows.select("_y", "_id", F.xxhash64("_text").alias("_h"), statistics(F.col("_text")).alias("s")).groupBy("_id", "_y").agg(F.min_by("s", "_h").alias("s")).select("_y", "_id", "s.*").toArrow().sort_by("_id")
    x = np.stack([got[k].to_numpy() for k in NAMES], axis=1) if got.num_rows else np.empty((0, len(NAMES)))
    return fit(x, got["_y"].to_numpy())


def predict(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = train(docs, labels, sample)
    found = docs.select("doc_id", model.column(F.col("text")).alias("score"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs whose score is at least 0.5."""
    return docs.where(train(docs, labels, sample).column(F.col("text")) >= 0.5)
