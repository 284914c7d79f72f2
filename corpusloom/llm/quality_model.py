"""Quality classifier as a sparse rule ensemble.

Shallow trees are grown on statistics of a bounded sample of labelled documents.  Each path from a root is a conjunctive rule.  A
logistic model with an L1 penalty weights the rules, most weights become zero, and the rest is compiled into one
Spark column expression, so scoring a corpus runs without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .textstats import with_base, with_style

FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "end_share": "n_ends / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "n_words": "n_words",
}
#: Labelled rows that the trees and weights are fitted on, at most; chosen by a hash of doc_id, of which so many cells are counted.
SAMPLE, CELLS = 20_000, 65_536
TREES, DEPTH, LEAF, PENALTY = 40, 3, 20, 0.002


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, is above, threshold), all of which hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.conditions:
            out &= (x[name] > at) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out


def best_split(x: np.ndarray, gradient: np.ndarray, leaf: int) -> tuple[float, float]:
    """(gain, threshold) of one feature for least squares on the gradient."""
    order = np.argsort(x, kind="stable")
    xs, total = x[order], np.cumsum(gradient[order])
    n, k = len(xs), np.arange(1, len(xs))
    gain = total[:-1] ** 2 / k + (total[-1] - total[:-1]) ** 2 / (n - k) - total[-1] ** 2 / n
    gain[(xs[1:] == xs[:-1]) | (k < leaf) | (n - k < leaf)] = -1
    i = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[i]), float((xs[i] + xs[i + 1]) / 2)) if len(gain) and gain[i] > 1e-9 else (0.0, 0.0)


def grow(x: dict, gradient: np.ndarray, rows: np.ndarray, names: list[str], depth: int, leaf: int, path: tuple, rules: set, out: np.ndarray) -> None:
    """Adds the rules of a tree's nodes and sets out to its leaves' means."""
    if path:
        rules.add(Rule(path))
    out[rows] = gradient[rows].mean()
    if depth == 0 or len(rows) < 2 * leaf:
        return
    found = max(((*best_split(x[f][rows], gradient[rows], leaf), f) for f in names), key=lambda s: s[0])
    if found[0] <= 0:
        return
    above = x[found[2]][rows] > found[1]
    for side in (False, True):
        grow(x, gradient, rows[above == side], names, depth - 1, leaf, (*path, (found[2], side, found[1])), rules, out)


class RuleEnsemble:
    """P(label 1) = sigmoid(intercept + sum of the weights of the rules that hold)."""

    def __init__(self, rules: list[Rule], weights: np.ndarray, intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, penalty: float = PENALTY, seed: int = 7) -> RuleEnsemble:
        """Without rows or with one label only there are no rules, and every score is the (smoothed) share of label 1."""
        n = len(y)
        share = (y.sum() + 1) / (n + 2)
        base = float(np.log(share / (1 - share)))
        if n < 2 * leaf or y.min() == y.max():
            return cls([], np.zeros(0), base)
        rng, margin, rules = np.random.default_rng(seed), np.full(n, base), set()
        names = sorted(x)
        for _ in range(trees):
            gradient = y - 1 / (1 + np.exp(-margin))
            some = [names[i] for i in sorted(rng.choice(len(names), max(2, len(names) * 2 // 3), replace=False))]
            step = np.zeros(n)
            grow(x, gradient, np.flatnonzero(rng.random(n) < 0.7) if n > 500 else np.arange(n), some, depth, leaf, (), rules, step)
            margin += 2 * step
        ordered = sorted(rules, key=lambda r: (len(r.conditions), r.conditions))
        z = np.stack([r.on(x) for r in ordered], axis=1).astype(np.float64)
        mean, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-3)
        z = (z - mean) / scale
        # accelerated proximal gradient for the L1 penalty
        step = 4 / max(np.linalg.norm(z, 2) ** 2 / n, 1e-9)
        w, ahead, b, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), base, 1.0
        for _ in range(400):
            off = 1 / (1 + np.exp(-(z @ ahead + b))) - y
            moved = ahead - step * (z.T @ off / n)
            fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            b -= 4 * off.mean()
            following = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = fresh + (t - 1) / following * (fresh - w), fresh, following
        w = w / scale
        keep = np.flatnonzero(np.abs(w) > 1e-4)
        return cls([ordered[i] for i in keep], w[keep], float(b - (w * mean)[keep].sum()))

    def score(self) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights.tolist()):
            margin = margin + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def features(documents: DataFrame) -> DataFrame:
    texts = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_style(with_base(texts)).select("doc_id", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the first cells of a hash of doc_id that hold `most` rows together at most; all rows, if there are no more.

    Counts by cell come to the driver, not candidates of each task, so what it gets has the same bound at every size.  Where even the
    first cell holds more, its rows are cut to `most` by the hash."""
    placed = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"))
    counts = np.zeros(CELLS, np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row for each cell
        counts[r["cell"]] = r["count"]
    fits = int(np.searchsorted(np.cumsum(counts), most, "right"))
    if fits == 0:
        return placed.where("cell = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return placed.where(F.col("cell") < fits)


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document.

    Learns from labelled rows outside the held-out fold, at most `sample` of them.  Null or empty text has all statistics
    0 and is scored like any other.  A null doc_id is never learnt from and is not held out.  Null labels are not learnt from; of a doc_id
    with several labels one is taken by value.  Without labels each score is 0.5.  An empty table gives an empty result."""
    stats = cut(features(documents))
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    learn = stats.join(one, "doc_id").where(~held_out(F.col("doc_id")))
    rows = bounded_sample(learn, sample).select("doc_id", "quality", *FEATURES).toPandas().sort_values("doc_id")
    model = RuleEnsemble.fit({f: rows[f].to_numpy(float) for f in FEATURES}, rows["quality"].to_numpy(float))
    scored = stats.withColumn("score", model.score())
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
