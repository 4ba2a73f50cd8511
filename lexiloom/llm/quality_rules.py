"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every document gets one vote of each rule: 1 (good), -1 (bad) or 0 (the rule abstains).
Given the unknown quality, votes are taken as independent. Vote patterns are counted in
one aggregation (at most 3 to the power of the number of rules, whatever the corpus), and
the rules' vote rates for good and bad documents are estimated on that table, abstentions
included, from a first guess that believes every fault. A document
is kept if its posterior probability of being good is at least ``threshold``. No Python
touches a row: all is DataFrame expressions; the driver sees one row of sums a round.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textstats import base_statistics

MIN_WORDS = 50
#: Estimation goes on until no rate moves by SETTLED; so many rounds without that are reported as a warning.
ROUNDS = 200
#: The first posterior: of a document that some rule faults, and of one that none does.
FAULTED, UNFAULTED = 0.05, 0.95
#: One imagined document of each class, spread over the votes -1, 0 and 1, keeps rates from 0.
IMAGINED = {"g": (0.02, 0.49, 0.49), "b": (0.3, 0.35, 0.35)}
#: Good documents are faulted by a rule at most so often; this keeps the two classes from changing places.
WRONG_AT_MOST = 0.05
LEAST = 0.005
SETTLED = 1e-4


def _vote(bad: Column, good: Column | None = None) -> Column:
    v = F.when(bad, -1)
    return (v.when(good, 1) if good is not None else v).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Name to vote. Ratios are compared as products, so an empty text divides by nothing."""
    n, chars, c = F.col("n_words"), F.col("word_chars"), F.col
    return {
        "symbols": _vote(10 * c("n_symbols") > n, 100 * c("n_symbols") <= n),
        "symbol_share": _vote(20 * c("n_symbols") > chars),
        "punctuation": _vote(8 * c("n_punctuation") > chars),
        "capitals": _vote(10 * c("n_upper") > 3 * chars),
        "shouting": _vote(5 * c("n_bang") > n),
        "repeated_lines": _vote((c("n_dup_lines") >= 2) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        "repeated_words": _vote(10 * c("n_repeat_words") > 3 * n, 10 * c("n_repeat_words") <= n),
        "vocabulary": _vote(c("n_distinct") * c("n_distinct") < 2 * n),
        "word_length": _vote((chars < 2 * n) | (chars > 14 * n)),
        "sentences": _vote((n >= 200) & (400 * c("n_stops") < n), (60 * c("n_stops") >= n) & (3 * c("n_stops") <= n)),
    }


def _posterior(model: dict | None, names: list[str]) -> Column:
    if model is None:
        return F.when(F.least(*names) < 0, F.lit(FAULTED)).otherwise(F.lit(UNFAULTED))
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name in names:
        odds = odds + F.element_at(F.array(*[F.lit(math.log(g / b)) for g, b in zip(*model["rates"][name])]), F.col(name) + 2)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict | None:
    """Vote rates by expectation-maximisation. ``patterns``: a column for each rule, and n.

    rates[name] holds P(vote -1, 0, 1) for good and for bad documents. None without documents.
    """
    model = None
    for _ in range(rounds):
        p = _posterior(model, names)
        rows = patterns.select("*", (F.col("n") * p).alias("_g"), (F.col("n") * (1 - p)).alias("_b"))
        sums = rows.agg(
            F.sum("_g").alias("g"), F.sum("_b").alias("b"),
            *[F.sum(F.when(F.col(r) == v, F.col(f"_{y}")).otherwise(0.0)).alias(f"{r}|{v}|{y}") for r in names for v in (-1, 0, 1) for y in "gb"],
        ).first()
        if sums["g"] is None:
            break

        def rate(r, y):
            x = [max(LEAST, (sums[f"{r}|{v}|{y}"] + IMAGINED[y][v + 1]) / (sums[y] + 1)) for v in (-1, 0, 1)]
            if y == "g":
                x[0] = min(x[0], WRONG_AT_MOST)
            return [v / sum(x) for v in x]

        new = {"prior": min(0.98, max(0.02, sums["g"] / (sums["g"] + sums["b"]))), "rates": {r: (rate(r, "g"), rate(r, "b")) for r in names}}
        moved = max(abs(p - q) for r in names for a, b in zip(new["rates"][r], model["rates"][r]) for p, q in zip(a, b)) if model else 1.0
        model = new
        if moved < SETTLED:
            break
    else:
        warnings.warn(f"the rates of the rules still moved by {moved:.2g} after {rounds} rounds", stacklevel=2)
    return model


def assess(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, the base statistics, base_failed, one vote a rule, p_good, kept.

    A null text counts as empty: all statistics 0, base_failed, not kept. Repeated rows
    are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    stats = materialise(base_statistics(docs, "doc_id"), "rules")
    names = list(rules())
    voted = stats.select("*", *[v.alias(f"vote_{r}") for r, v in rules().items()])
    patterns = materialise(voted.groupBy(*[F.col(f"vote_{r}").alias(r) for r in names]).agg(F.count("*").alias("n")).repartition(1), "votes")
    model = fit(patterns, names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    plain = voted.select(*stats.columns, *[F.col(f"vote_{r}").alias(r) for r in names])
    judged = plain.select("*", failed.alias("base_failed"), _posterior(model, names).alias("p_good"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
