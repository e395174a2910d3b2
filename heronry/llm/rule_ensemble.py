"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on bootstrap samples of labelled rows; each path of theirs is a rule, a conjunction of conditions on
statistics.  A logistic regression with an L1 penalty gives most rules the weight 0.  What is left is compiled into one Spark column
expression, so scoring runs no Python.  Only a bounded sample of labelled rows comes to the driver, as numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.quality_rules import SPACES, STOP_WORDS, SYMBOLS

#: Labelled rows that the fit takes at most: those of the smallest hashes of their ids.
MOST_ROWS = 20_000
STATISTICS = ("log_words", "word_length", "symbols", "bars", "marks", "upper", "stops", "echoes", "fresh_runs", "new_words", "dup_lines", "line_words")


def statistics(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """The column ``carry`` and the statistics as doubles, for each row of (carry, text); a null text is empty. None of them is ever null."""
    d = docs.select(carry, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    runs = F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    n, lines = F.greatest(F.size("words"), F.lit(1)).cast("double"), F.greatest(F.size("lines"), F.lit(1)).cast("double")
    d = d.withColumn("n", n).withColumn("n_lines", lines)
    share = lambda c: c.cast("double") / F.col("n")
    return d.select(
        carry,
        F.log1p(F.size("words").cast("double")).alias("log_words"),
        share(F.length(F.array_join("words", ""))).alias("word_length"),
        share(F.regexp_count("text", F.lit(SYMBOLS))).alias("symbols"),
        share(F.regexp_count("text", F.lit(r"\|"))).alias("bars"),
        share(F.regexp_count("text", F.lit("[!?]"))).alias("marks"),
        share(F.regexp_count("text", F.lit("[A-ZÀ-ÖØ-Þ]{3,}"))).alias("upper"),
        share(F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("stops"),
        share(F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get(F.col("words"), i - 1))))).alias("echoes"),
        share(F.size(F.array_distinct(runs))).alias("fresh_runs"),
        (F.size(F.array_distinct("words")).cast("double") / F.sqrt("n")).alias("new_words"),
        ((F.size("lines") - F.size(F.array_distinct("lines"))).cast("double") / F.col("n_lines")).alias("dup_lines"),
        (F.col("n") / F.col("n_lines")).alias("line_words"),
    )


@dataclass(frozen=True)
class PathRule:
    """Holds where each (statistic, above, threshold) does: value > threshold if above, else value <= threshold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.conditions:
            out &= (x[:, k] > t) if above else (x[:, k] <= t)
        return out

    def column(self) -> Column:
        out = None
        for k, above, t in self.conditions:
            c = F.col(STATISTICS[k]) > t if above else F.col(STATISTICS[k]) <= t
            out = c if out is None else out & c
        return out


def _grow(x: np.ndarray, y: np.ndarray, features: np.ndarray, depth: int, least: int, path: tuple, out: set) -> None:
    """Adds the paths of a tree that splits by Gini impurity at quantiles."""
    if path:
        out.add(PathRule(path))
    p = y.mean()
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return
    best = (1e-9, 0, 0.0)
    for k in features:
        v = x[:, k]
        for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 49))):
            low = v <= t
            a = int(low.sum())
            if least <= a <= len(y) - least:
                pa, pb = y[low].mean(), y[~low].mean()
                gain = p * (1 - p) - (a * pa * (1 - pa) + (len(y) - a) * pb * (1 - pb)) / len(y)
                if gain > best[0]:
                    best = (gain, int(k), float(t))
    if best[0] > 1e-9:
        _, k, t = best
        low = x[:, k] <= t
        _grow(x[low], y[low], features, depth - 1, least, (*path, (k, False, t)), out)
        _grow(x[~low], y[~low], features, depth - 1, least, (*path, (k, True, t)), out)


def path_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rows: int = 4000, seed: int = 7) -> list[PathRule]:
    """Rules of ``trees`` trees, each on a balanced bootstrap sample and a random half of the statistics."""
    rng, out = np.random.default_rng(seed), set()
    one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(trees):
        take = np.concatenate([rng.choice(side, min(rows // 2, len(side) * 4)) for side in (one, zero)])
        _grow(x[take], y[take], rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False), depth, max(4, len(take) // 200), (), out)
    return sorted(out, key=lambda r: r.conditions)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient; the classes weigh alike on average."""
    w, b, n = np.zeros(z.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), len(y)
    v, c, t = w.copy(), b, 1.0
    size = 4.0 * n / (np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - size * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_b = c - size * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return float(b), w


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[PathRule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, from the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((r.of(x) * w for r, w in self.rules), np.zeros(len(x))))))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """A model of rows x and labels y (1: good); without rows or with one class, a constant."""
    if not len(y) or y.min() == y.max():
        return RuleModel(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), ())
    rules = path_rules(x, y, seed=seed)
    b, w = lasso_logistic(np.column_stack([r.of(x) for r in rules]).astype(float), y, penalty)
    return RuleModel(b, tuple((r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, penalty: float = 0.002) -> RuleModel:
    """Fits on at most ``most_rows`` labelled rows that aren't held out; ids with labels of both kinds are left out."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y1")).where("y = y1").select("doc_id", "y")
    # bounded: most_rows ids and labels
    sample = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left_semi")).join(F.broadcast(known), "doc_id")
    rows = sorted(tuple(r) for r in sample.select(*STATISTICS, "y").collect())
    x = np.array([r[:-1] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, np.array([r[-1] for r in rows], float), penalty)


def keep_good(docs: DataFrame, model: RuleModel, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, whatever these are named."""
    whole = docs.select(F.struct("*").alias("_row"), "text")
    scored = statistics(whole, "_row").select("_row", model.score().alias("_score"))
    # a generator rather than a filter: a filter would be pushed below the statistics, and each of its conditions would compute them anew
    return scored.select(F.explode(F.when(F.col("_score") >= threshold, F.array("_row"))).alias("_row")).select("_row.*")


def classify(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of (doc_id, text).

    Null, empty and white-space texts have the statistics of no words and are scored like others.  Repeated and null ids are no matter; a null
    id isn't held out.  A tie with the threshold counts as 1.  One projection, no shuffle.
    """
    scored = statistics(docs.select("doc_id", "text")).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
