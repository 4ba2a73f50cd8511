"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on a bounded labelled sample; every path from a root to
a node is a rule, a lasso logistic regression weighs the rules, and those with a weight
left are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, training_rows
from .textstats import SYMBOLS, UPPER, count_of, words_of

#: At most so many labelled rows are learnt from: those whose hashed ids are smallest.
SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = ["n_words", "word_length", "symbols", "capitals", "bangs", "stops", "commas", "digits", "distinct", "words_a_line", "distinct_lines", "repeats"]


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and FEATURES as doubles, of the whole text; a null text counts as empty."""
    t, w, ls = F.col("_text"), F.col("_words"), F.col("_lines")
    d = docs.select(*keep, text_of().alias("_text")).select("*", words_of(F.col("_text")).alias("_words"), F.split("_text", "\n").alias("_lines"))
    n = F.greatest(F.size(w), F.lit(1)).cast("double")
    pairs = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    values = {
        "n_words": F.size(w),
        "word_length": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")) / n,
        "symbols": count_of(t, SYMBOLS) / n,
        "capitals": count_of(t, UPPER) / n,
        "bangs": count_of(t, "!") / n,
        "stops": count_of(t, ".?") / n,
        "commas": count_of(t, ",;:") / n,
        "digits": count_of(t, "0123456789") / n,
        "distinct": F.size(F.array_distinct(w)) / n,
        "words_a_line": n / F.size(ls),
        "distinct_lines": F.size(F.array_distinct(ls)) / F.size(ls),
        "repeats": 1 - F.size(F.array_distinct(pairs)) / n,
    }
    return d.select(*keep, *[F.when(F.size(w) == 0, F.lit(0.0)).otherwise(values[f].cast("double")).alias(f) for f in FEATURES])


Rule = tuple[tuple[int, bool, float], ...]  #: (feature, above, cut): all must hold


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            hold = F.lit(True)
            for f, above, cut in rule:
                c = F.col(FEATURES[f])
                hold = hold & (c > cut if above else c <= cut)
            z = z + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _tree(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Second-order regression tree on gradients; the paths of all its nodes, and its fit."""
    rules: list[Rule] = []
    out = np.zeros(len(g))
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(g)), ())]
    while todo:
        rows, path = todo.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        out[rows] = -gs / (hs + 1.0)
        best = (1e-6, -1, 0)
        if len(path) < depth:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=len(c) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] >= 0:
            _, f, k = best
            left = binned[rows, f] <= k
            for side, above in ((left, False), (~left, True)):
                p = (*path, (f, above, float(cuts[f][k])))
                rules.append(p)
                todo.append((rows[side], p))
    return rules, out


def _simplify(rule: Rule) -> Rule:
    kept: dict[tuple[int, bool], float] = {}
    for f, above, cut in rule:
        kept[f, above] = (max if above else min)(kept.get((f, above), cut), cut)
    return tuple(sorted((f, a, c) for (f, a), c in kept.items()))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, cut in rule:
        ok &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return ok


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 2e-3, steps: int = 400) -> RuleModel:
    """Grow trees, collect their paths, and weigh them by lasso logistic regression (proximal gradient with momentum).

    Without rows, or with one class only, the model is a constant.
    """
    n = len(y)
    prior = (y.sum() + 1) / (n + 2) if n else 0.5
    b0 = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return RuleModel(b0, ())
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 48), method="lower")) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    f, rules = np.full(n, b0), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        paths, step = _tree(x, cuts, binned, p - y, p * (1 - p), depth, max(5, n // 500))
        f += 0.3 * step
        rules.update(dict.fromkeys(map(_simplify, paths)))
    rules = list(rules)
    m = np.stack([_holds(x, r) for r in rules], 1).astype(np.float64) if rules else np.zeros((n, 0))
    w, b = np.zeros(m.shape[1]), b0
    vw, vb, t = w.copy(), b, 1.0
    rate = 4.0 / (np.linalg.norm(np.c_[m, np.ones(n)], 2) ** 2 / n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(m @ vw + vb))) - y
        nw = vw - rate * (m.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return RuleModel(float(b), tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Learn from at most ``sample`` labelled documents, never from a row whose crc32 says held out.

    A document that is labelled or stored several times counts once, with its lower label
    and its text first in order, so that what comes to the driver stays bounded.
    """
    ok = labels.select("doc_id", F.col("quality").cast("double").alias("_y")).where(F.col("_y").isNotNull() & F.col("doc_id").isNotNull() & training_rows())
    chosen = ok.groupBy("doc_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))  # at most ``sample`` rows of two numbers are broadcast
    rows = features(joined, "_y").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.float64).reshape(-1, len(FEATURES))
    y = np.array([r["_y"] for r in rows])
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null text counts as empty and gets the score of an empty text; a null doc_id isn't
    held out; repeated rows score alike; without labels every score is 0.5.
    """
    model = train(docs, labels, sample)
    scored = features(docs, "doc_id").select("doc_id", F.coalesce(~training_rows(), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents with predicted quality 1, all columns as they were.

    A null text counts as empty; rows are judged by their texts alone, so repeats and null
    ids make no difference. Columns of any name are fine.
    """
    model = train(docs, labels, sample)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    # a column that isn't deterministic keeps the filter above the features: below, every rule would work them out again
    held = features(row, "_row").withColumn("_here", F.monotonically_increasing_id())
    return held.where((F.col("_here") >= 0) & (model.score() >= THRESHOLD)).select("_row.*")
