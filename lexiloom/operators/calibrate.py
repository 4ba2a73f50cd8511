"""Evaluation and calibration: ranking quality, threshold searches, confusion counts.

Records are rows (kind, coverage, margin, rank): kind pos or neg, rank of the right answer
from 1, 0 if it wasn't found. Thresholds have four places and what they are compared with
are shares, so there are TEN_THOUSAND + 1 of them at most. Searches never pair records
with thresholds: records are counted into places of a grid, and counts are cumulated over
it. What the driver sees is one row a threshold at most; where all pairs of thresholds
matter, blocks of them are cumulated on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEN_THOUSAND, BLOCK = 10_000, 100
MARGINS = (0.0, 0.04, 0.08, 0.12, 0.18, 0.24, 0.3, 0.38, 0.46, 0.55, 0.7)
DENSE_MARGINS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.55, 0.7)


def ceil4(x: Column) -> Column:
    """Rounded up to 4 places, so that a threshold never lets in what it was set to keep out."""
    return F.ceil(x * 10_000) / 10_000


def gold_rank(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank): the best rank of a gold pair (query_id, id) among candidates (query_id, id, rk); 0 if there is none."""
    hit = candidates.join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rk").alias("rank"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"))


def rank_report(ranks: DataFrame, depth: int = 5) -> DataFrame:
    """One row: n, recall_1, recall_5, mrr of rows (rank)."""
    r = F.col("rank")
    return ranks.agg(F.count("*").alias("n"), F.avg((r == 1).cast("int")).alias("recall_1"), F.avg(((r > 0) & (r <= depth)).cast("int")).alias(f"recall_{depth}"), F.avg(F.when(r > 0, 1 / r).otherwise(0.0)).alias("mrr"))


def pool_report(ranks: DataFrame) -> DataFrame:
    """One row: n, reached, reach_rate and the median rank of what was reached."""
    r = F.col("rank")
    return ranks.agg(F.count("*").alias("n"), F.count_if(r > 0).alias("reached"), F.avg((r > 0).cast("int")).alias("reach_rate"), F.percentile(F.when(r > 0, r), 0.5).alias("median_rank"))


def _reached(x: Column) -> Column:
    """How many ten-thousandths ``x`` reaches: x >= t / 10000 exactly if that is t or more. Beyond 0 and 1, as those."""
    up = F.ceil(x * TEN_THOUSAND)
    return F.least(F.greatest(F.when(x >= up / TEN_THOUSAND, up).otherwise(up - 1), F.lit(-1)), F.lit(TEN_THOUSAND)).cast("int")


def _up(x: Column) -> Column:
    """``x`` in ten-thousandths, rounded up."""
    return F.ceil(x * TEN_THOUSAND).cast("int")


def _one(records: DataFrame, schema: str, rows: list[tuple]) -> DataFrame:
    return records.sparkSession.createDataFrame(rows, schema)


def _grid(records: DataFrame, taus: list[float], deltas: tuple[float, ...]) -> Iterator[dict[str, float]]:
    """Counts for each pair of a threshold and a margin, in their order.

    A record is counted once, under the numbers of thresholds and of margins that it
    reaches; the driver cumulates these few hundred counts.
    """
    reach = lambda x, of: F.size(F.filter(F.array(*map(F.lit, of)), lambda t: x >= t)) if of else F.lit(0)
    pos, right = F.col("kind") == "pos", F.col("rank") == 1
    cells = records.groupBy(reach(F.col("coverage"), taus).alias("i"), reach(F.col("margin"), deltas).alias("j")).agg(F.count_if(pos & right).alias("right"), F.count_if(pos & ~right).alias("wrong"), F.count_if(~pos).alias("false"))
    at = np.zeros((3, len(taus) + 2, len(deltas) + 2), np.int64)
    for r in cells.collect():
        at[:, r["i"], r["j"]] += (r["right"], r["wrong"], r["false"])
    reached = at[:, ::-1, ::-1].cumsum(1).cumsum(2)[:, ::-1, ::-1]
    n_pos, n_neg = int(at[:2].sum()), int(at[2].sum())
    for i, tau in enumerate(taus, 1):
        for j, delta in enumerate(deltas, 1):
            yield {"tau": tau, "delta": delta, "n_pos": n_pos, "n_neg": n_neg} | dict(zip(("right", "wrong", "false"), map(int, reached[:, i, j])))


def _quantiles(values: DataFrame, column: str, low: float, high: float, n: int) -> list[float]:
    shares = [low + (high - low) * i / (n - 1) for i in range(n)]
    return sorted(set(values.agg(F.percentile(column, shares).alias("t")).first()["t"] or []))


def precision_sweep(records: DataFrame, target: float = 0.9) -> DataFrame:
    """The thresholds that answer most at the target precision, on a grid of coverage quantiles and margins; no row if none does."""
    taus = _quantiles(records.select(F.round("coverage", 3).alias("c")).distinct(), "c", 0.02, 0.98, 40)
    found = []
    for g in _grid(records, taus, MARGINS):
        answered = g["right"] + g["wrong"]
        if answered and g["right"] / (answered + g["false"]) >= target:
            found.append((g["tau"], g["delta"], g["right"] / (answered + g["false"]), answered / g["n_pos"], g["false"] / g["n_neg"] if g["n_neg"] else None))
    best = sorted(found, key=lambda x: (-x[3], x[0], x[1]))[:1]
    return _one(records, "tau double, delta double, precision double, answer_rate double, false_match_rate double", best)


def dense_sweep(records: DataFrame, least: int = 5, best: int = 5) -> DataFrame:
    """The most precise thresholds that answer at least ``least`` records."""
    found = []
    for g in _grid(records, _quantiles(records, "coverage", 0.3, 0.999, 40), DENSE_MARGINS):
        answered = g["right"] + g["wrong"] + g["false"]
        if answered >= least:
            found.append((g["right"] / answered, answered, g["right"] / max(1, g["n_pos"]), g["tau"], g["delta"]))
    top = sorted(found, key=lambda x: (-x[0], -x[1], x[3], x[4]))[:best]
    return _one(records, "precision double, answered long, recall double, tau double, delta double", top)


def zero_false_sweep(records: DataFrame) -> DataFrame:
    """The thresholds that admit no negative and answer most, then most correctly; the first by tau of equal ones.

    For each coverage observed on a positive, the margin is the greatest of the negatives
    at or above it, rounded up. Of the margins of one threshold the smallest that keeps all
    negatives out is best. These fall as thresholds rise, so a positive is answered at a
    run of thresholds, and counts change only where runs begin and end.
    """
    pos = F.col("kind") == "pos"
    r = records.select("coverage", "margin", "rank", pos.alias("pos"), _up(F.col("coverage")).alias("c_up"), _reached(F.col("coverage")).alias("c"), _reached(F.col("margin")).alias("m"))
    up = Window.partitionBy("c_up").orderBy(F.desc("coverage")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marks = r.groupBy("c_up", "coverage").agg(F.max(F.when(~F.col("pos"), _up(F.col("margin")))).alias("top"), F.count_if(F.col("pos")).alias("n"))
    own = marks.withColumn("own", F.max("top").over(up)).where("n > 0").select("c_up", "own")
    size = TEN_THOUSAND + 2

    def cumulated(by: str, margin: Column) -> np.ndarray:
        """Of the negatives at or above each threshold, the greatest margin; -2 without any."""
        out = np.full(size, -2, np.int64)
        for x in r.where(~F.col("pos")).groupBy(by).agg(F.max(margin).alias("top")).collect():
            if x[by] is not None and x["top"] is not None:
                k = min(max(x[by], 0), size - 1)
                out[k] = max(out[k], x["top"])
        return np.maximum.accumulate(out[::-1])[::-1]

    above, kept_out = cumulated("c_up", _up(F.col("margin"))), cumulated("c", F.col("m"))
    spark = records.sparkSession
    at = F.broadcast(spark.createDataFrame([(t, int(above[t + 1]) if t + 1 < size else -2, int(kept_out[t])) for t in range(TEN_THOUSAND + 1)], "c_up int, above int, out int"))
    delta = F.greatest(F.coalesce("own", F.lit(-2)), F.col("above"))
    delta = F.when(delta == -2, 0).otherwise(delta)
    cuts = sorted(((x["c_up"], x["d"]) for x in own.join(at, "c_up").withColumn("d", delta).where("d > out").groupBy("c_up").agg(F.min("d").alias("d")).collect()), reverse=True)
    n_pos, n_neg = r.agg(F.count_if("pos"), F.count_if(~F.col("pos"))).first()
    schema = "tau double, delta double, answered long, correct long, n_pos long, n_neg long"
    if not cuts:
        return _one(records, schema, [])
    taus, deltas = np.array([-t for t, _ in cuts]), np.array([d for _, d in cuts])
    first = np.searchsorted(taus, -np.arange(-1, TEN_THOUSAND + 1), side="left")  # the first cut, tau falling, that a coverage reaches
    last = np.searchsorted(deltas, np.arange(-1, TEN_THOUSAND + 1), side="right")  # the first cut, delta rising, that a margin misses
    begins = F.broadcast(spark.createDataFrame([(c, int(k)) for c, k in zip(range(-1, TEN_THOUSAND + 1), first)], "c int, begins int"))
    ends = F.broadcast(spark.createDataFrame([(m, int(k)) for m, k in zip(range(-1, TEN_THOUSAND + 1), last)], "m int, ends int"))
    runs = r.where("pos").join(begins, "c").join(ends, "m").where("begins < ends").select(F.explode(F.array(F.struct(F.col("begins").alias("at"), F.lit(1).alias("by")), F.struct(F.col("ends").alias("at"), F.lit(-1).alias("by")))).alias("e"), (F.col("rank") == 1).cast("int").alias("right"))
    change = np.zeros((2, len(cuts) + 1), np.int64)
    for x in runs.groupBy("e.at").agg(F.sum("e.by").alias("n"), F.sum(F.col("e.by") * F.col("right")).alias("ok")).collect():
        change[:, x["at"]] += (x["n"], x["ok"])
    answered, correct = change.cumsum(1)
    best = min(range(len(cuts)), key=lambda i: (-answered[i], -correct[i], cuts[i]))
    return _one(records, schema, [(cuts[best][0] / TEN_THOUSAND, cuts[best][1] / TEN_THOUSAND, int(answered[best]), int(correct[best]), n_pos, n_neg)])


def _searched(cells: DataFrame, taus: list[int], counts: list[str], judge: Callable[[int, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """What ``judge`` makes of each threshold: rows of ``schema``.

    ``cells`` (c, m, counts) are counts of records by the ten-thousandths that their two
    shares reach. judge(tau, sums) gets the counts of the records with c >= tau and margin
    m or more, a row for each m. Blocks of thresholds are worked on by themselves, each
    with the counts of all that lies above it, so no record is paired with a threshold.
    """
    mine = np.array(sorted(taus, reverse=True))
    block = F.floor(F.greatest("c", F.lit(0)) / BLOCK).cast("int")
    placed = cells.where("c >= 0 and m >= 0").withColumn("block", block)
    by_block = placed.groupBy("block", "m").agg(*[F.sum(n).alias(n) for n in counts])
    # a row for each block and each m: the sums of all blocks above
    grid = by_block.select("m").distinct().select("m", F.explode(F.sequence(F.lit(0), F.lit(TEN_THOUSAND // BLOCK))).alias("block"))
    higher = Window.partitionBy("m").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = grid.join(by_block, ["block", "m"], "left").select(F.col("block").alias("under"), F.col("m").alias("margin"), *[F.coalesce(F.sum(n).over(higher), F.lit(0)).alias(n) for n in counts])
    names = [f.split()[0] for f in schema.split(", ")]

    def work(own: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((TEN_THOUSAND + 1, len(counts)), np.int64)
        sums[over["margin"].to_numpy()] = over[counts].to_numpy()
        own = own.sort_values("c", ascending=False)
        c, m, n = own["c"].to_numpy(), own["m"].to_numpy(), own[counts].to_numpy()
        low = int(over["under"].iloc[0]) * BLOCK
        out, done = [], 0
        for tau in mine[(mine >= low) & (mine < low + BLOCK)].tolist():
            upto = int(np.searchsorted(-c, -tau, side="right"))
            np.add.at(sums, m[done:upto], n[done:upto])
            done = upto
            row = judge(tau, sums[::-1].cumsum(0)[::-1])
            if row is not None:
                out.append(row)
        return pd.DataFrame(out, columns=names)

    return placed.groupBy("block").cogroup(above.groupBy("under")).applyInPandas(work, schema)


def combined_sweep(records: DataFrame) -> DataFrame:
    """The most precise of all observed pairs of thresholds, of equal ones that which answers most; precision, answered, correct, tau, delta."""
    right = (F.col("kind") == "pos") & (F.col("rank") == 1)
    m = F.floor(F.round(F.col("margin") * TEN_THOUSAND, 6)).cast("int")
    cells = records.groupBy(_reached(F.col("coverage")).alias("c"), F.least(m, F.lit(TEN_THOUSAND)).alias("m")).agg(F.count("*").alias("n"), F.count_if(right).alias("ok"))
    taus = [x["t"] for x in records.select(F.round(F.round("coverage", 4) * TEN_THOUSAND).cast("int").alias("t")).distinct().collect()]

    def judge(tau: int, sums: np.ndarray) -> tuple | None:
        n, ok = sums[:, 0], sums[:, 1]
        seen = np.append(n[:-1] > n[1:], n[-1] > 0)  # margins that some record has
        if not seen.any():
            return None
        share = np.where(seen, ok / np.maximum(n, 1), -1.0)
        k = np.lexsort((np.arange(len(n)), -n, -share))[0]
        return float(share[k]), int(n[k]), int(ok[k]), tau / TEN_THOUSAND, int(k) / TEN_THOUSAND

    found = _searched(cells, taus, ["n", "ok"], judge, "precision double, answered long, correct long, tau double, delta double")
    return found.orderBy(F.desc("precision"), F.desc("answered"), "tau", "delta").limit(1)


def accept_rates(records: DataFrame, absolute: float, relative: float, projects: list[str] | None = None) -> DataFrame:
    """(population, n, rate) of verifier records (project, population, evidence, rel_evidence, pattern_fired)."""
    r = records if projects is None else records.where(F.col("project").isin(projects))
    on = F.col("pattern_fired") | ((F.col("evidence") >= absolute) & (F.col("rel_evidence") >= relative))
    return r.groupBy("population").agg(F.count("*").alias("n"), F.avg(on.cast("int")).alias("rate"))


def dominating(records: DataFrame, absolute: float, relative: float, positive: str = "correct") -> DataFrame:
    """Thresholds (tau_abs, tau_rel, rate) that accept more correct proposals than the given ones, and no more of any other population.

    Candidates are the values observed on correct proposals, rounded to 4 places. The best
    rate, of equal ones the smallest thresholds; no row if there is none.
    """
    fired = F.col("pattern_fired")
    given = (F.col("evidence") >= absolute) & (F.col("rel_evidence") >= relative)
    sizes = records.groupBy("population").agg(F.count("*").alias("n"), F.count_if(fired).alias("fired"), F.count_if(fired | given).alias("base")).orderBy("population").collect()  # a row a kind of proposal
    kinds = [x["population"] for x in sizes]
    if positive not in kinds:
        return _one(records, "tau_abs double, tau_rel double, rate double", [])
    observed = lambda c: sorted(x["t"] for x in records.where(F.col("population") == positive).select(F.round(F.round(c, 4) * TEN_THOUSAND).cast("int").alias("t")).distinct().collect())
    relatives = np.array([t for t in observed("rel_evidence") if 0 <= t <= TEN_THOUSAND])
    names = [f"n{i}" for i in range(len(kinds))]
    open_ = records.where(~fired).select("population", _reached(F.col("evidence")).alias("c"), _reached(F.col("rel_evidence")).alias("m"))
    cells = open_.groupBy("c", "m").agg(*[F.count_if(F.col("population") == k).alias(n) for n, k in zip(names, kinds)])
    own, room = kinds.index(positive), np.array([x["base"] - x["fired"] for x in sizes])
    n_own, fired_own = sizes[own]["n"], sizes[own]["fired"]
    others = [i for i in range(len(kinds)) if i != own]

    def judge(tau: int, sums: np.ndarray) -> tuple | None:
        at = sums[relatives]
        ok = (at[:, own] > room[own]) & (at[:, others] <= room[others]).all(axis=1)
        if not ok.any():
            return None
        k = int(ok.argmax())  # counts fall as the threshold rises, so the first one that will do accepts most
        return tau / TEN_THOUSAND, int(relatives[k]) / TEN_THOUSAND, float((at[k, own] + fired_own) / n_own)

    found = _searched(cells, [t for t in observed("evidence") if 0 <= t <= TEN_THOUSAND], names, judge, "tau_abs double, tau_rel double, rate double")
    return found.orderBy(F.desc("rate"), "tau_abs", "tau_rel").limit(1)


def score_predictions(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of counts and rates for tasks (id, arm, gold) and predictions (id, prediction); null or no prediction abstains, the latter is missing too."""
    p = predictions.groupBy("id").agg(F.max("prediction").alias("prediction")).withColumn("_has", F.lit(True))
    j = tasks.select("id", "arm", "gold").join(p, "id", "left")
    present, said = F.col("arm") == "present", F.col("prediction").isNotNull()
    right = present & said & F.array_contains("gold", F.col("prediction"))
    c = j.agg(
        F.count_if(present).alias("n_present"), F.count_if(~present).alias("n_absent"), F.count_if(right).alias("tp"), F.count_if(present & said).alias("answered"),
        F.count_if(~present & said).alias("bad"), F.count_if(F.col("_has").isNull()).alias("missing_predictions"),
    )
    share = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 4)
    return c.select(
        "n_present", "n_absent", F.round(F.col("tp") / F.nullif(F.col("answered") + F.col("bad"), F.lit(0)), 4).alias("precision"), share(F.col("tp"), F.col("n_present")).alias("recall"),
        share(F.col("answered"), F.col("n_present")).alias("answer_rate_present"), share(F.col("bad"), F.col("n_absent")).alias("false_match_rate_absent"), "missing_predictions",
    )


def task_rows(statements: DataFrame, deployed: DataFrame, library: DataFrame, project: str = "paper") -> DataFrame:
    """Benchmark tasks from annotated statements (id, title, text, section, targets): answerable ones by ``deployed``, unanswerable ones by ``library``; one statement may give both."""
    from .relational import keep_known

    base = ["id", "title", "text", "section", "targets"]
    both = keep_known(statements.select(*base, F.col("targets").alias("gold")), deployed, "gold")
    present = both.where(F.size("gold") > 0).select(F.concat(F.lit(f"{project}::present::"), "id").alias("id"), F.lit("present").alias("arm"), F.lit("deployed").alias("corpus"), "title", "text", "section", "gold")
    none = keep_known(statements.select(*base, F.col("targets").alias("gold")), library, "gold")
    absent = none.where((F.size("targets") > 0) & (F.size("gold") == 0)).select(F.concat(F.lit(f"{project}::absent::"), "id").alias("id"), F.lit("absent").alias("arm"), F.lit("library").alias("corpus"), "title", "text", "section", "gold")
    return present.unionByName(absent)
