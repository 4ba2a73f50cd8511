"""Arms of an evaluation: what the jobs give for labelled statements, as the records that searches and reports read.

Statements are rows (query_id, text, title, targets); targets are the names that would be
right. Every arm is a batch: one retrieval over all of its statements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Retrieval, Verification
from ..functions.lexical import draw
from ..sources.store import settled
from .audit import SLICES, verify
from .calibrate import gold_rank, pool_report
from .lexicon import Lexicon
from .relational import keep_known
from .retrieve import align, query_weights, ranked, scores, separation
from .vectors import fuse, top_k

DEPTH = 5


def answered(statements: DataFrame, lexicon: Lexicon, kind: Column | str, c: Retrieval = Retrieval(), depth: int = DEPTH) -> DataFrame:
    """Records (query_id, kind, status, coverage, margin, rank): rank is that of the first target among the ``depth`` best, 0 without one."""
    out = align(statements.select("query_id", "text", "title"), lexicon, c, depth)
    hit = F.array_min(F.transform(F.filter("candidates", lambda x: F.array_contains("targets", x["name"])), lambda x: x["rk"]))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return statements.select("query_id", "targets").join(out, "query_id").select("query_id", kind.alias("kind"), "status", "coverage", "margin", F.coalesce(hit, F.lit(0)).alias("rank"))


def docstring_arms(known: DataFrame, unseen: DataFrame, lexicon: Lexicon, c: Retrieval = Retrieval()) -> DataFrame:
    """Records of docstrings (query_id, name, text): of declarations in the lexicon (pos), and of those held out of it (neg)."""
    own = lambda d, kind, t: d.select(F.concat(F.lit(kind), F.col("query_id").cast("string")).alias("query_id"), "text", F.lit("").alias("title"), t.cast("array<string>").alias("targets"))
    # one retrieval for both; an id may be in both arms
    r = answered(own(known, "pos", F.array("name")).union(own(unseen, "neg", F.array())), lexicon, F.left("query_id", F.lit(3)), c)
    return r.withColumn("query_id", F.substr("query_id", F.lit(4)).cast(known.schema["query_id"].dataType))


def _split(statements: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Statements with gold: those of their targets that the lexicon has."""
    return keep_known(statements.withColumn("gold", F.col("targets")), lexicon.rows.select("name").distinct(), "gold")


def paper_arms(statements: DataFrame, present: Lexicon, absent: Lexicon, c: Retrieval = Retrieval()) -> DataFrame:
    """Records of annotated statements: against a lexicon that has their declarations (pos), and one that lacks them (neg).

    A statement of which the second lexicon has a target after all is no negative.
    """
    neg = _split(statements, absent).where(F.size("gold") == 0).drop("gold")
    return answered(statements, present, "pos", c).union(answered(neg, absent, "neg", c))


def present_arm(statements: DataFrame, lexicon: Lexicon, c: Retrieval = Retrieval()) -> tuple[DataFrame, DataFrame]:
    """Records of the statements that have a target in the lexicon, and a row of n, recall_1, recall_5 and the answered share."""
    there = _split(statements, lexicon).where(F.size("gold") > 0).drop("targets").withColumnRenamed("gold", "targets")
    r = answered(there, lexicon, "pos", c)
    share = lambda x: F.round(F.avg(x.cast("int")), 3)
    return r, r.agg(F.count("*").alias("n"), share(F.col("rank") == 1).alias("recall_1"), share(F.col("rank") > 0).alias("recall_5"), share(F.col("status") != "unmatched").alias("answered"))


def absent_arm(statements: DataFrame, lexicon: Lexicon, c: Retrieval = Retrieval()) -> tuple[DataFrame, DataFrame]:
    """Records of the statements that have no target in the lexicon, and a row of n, correct_abstention, false_match_rate and the number of each status."""
    gone = _split(statements, lexicon).where(F.size("gold") == 0).drop("gold")
    r = answered(gone, lexicon, "neg", c)
    s, n = F.col("status"), F.count("*")
    false = F.count_if(s == "matched")
    return r, r.agg(n.alias("n"), F.round((n - false) / n, 3).alias("correct_abstention"), F.round(false / n, 3).alias("false_match_rate"), *[F.count_if(s == k).alias(k) for k in ("matched", "ambiguous", "unmatched")])


def pool_reach(statements: DataFrame, lexicon: Lexicon, depth: int = 10_000, c: Retrieval = Retrieval()) -> DataFrame:
    """How many statements with a target have one among the ``depth`` best, and its median rank: n, reached, reach_rate, median_rank."""
    ids = lexicon.rows.select(F.col("name").alias("target"), F.col("decl_id").alias("id"))
    gold = statements.select("query_id", F.explode(F.array_distinct("targets")).alias("target")).join(ids, "target").select("query_id", "id")
    asked = statements.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    pool = ranked(scores(settled(query_weights(asked, lexicon, c)), lexicon, c), depth).select("query_id", F.col("decl_id").alias("id"), "rk")
    return pool_report(gold_rank(pool, gold))


def verifier_arms(statements: DataFrame, lexicon: Lexicon, c: Retrieval = Retrieval(), patterns: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Records (project, population, evidence, rel_evidence, pattern_fired) of proposals for statements (and project).

    correct: the first target that the lexicon has; top_wrong: the best candidate that is
    no target; random: a name chosen by hash. Taken at thresholds of 0, so that any others
    can be searched over the rows. ``patterns`` as in :func:`audit.verify`.
    """
    there = settled(_split(statements, lexicon).where(F.size("gold") > 0))
    found = align(there.select("query_id", "text", "title"), lexicon, c, DEPTH)
    wrong = F.get(F.filter("candidates", lambda x: ~F.array_contains("gold", x["name"])), F.lit(0))["name"]
    # of the names in the statement's slice, the first from a hashed point on, else the first of all
    names = lexicon.rows.select(F.col("name").alias("other")).distinct().withColumn("slice", draw(F.col("other")) % SLICES)
    point = draw(f"random{seed}", F.col("query_id"))
    drawn = there.select("query_id", (point % SLICES).alias("slice"), point.alias("point")).join(names, "slice")
    after = F.min_by("other", F.when(draw(F.col("other")) >= F.col("point"), draw(F.col("other"))))
    random = drawn.groupBy("query_id").agg(F.coalesce(after, F.min_by("other", draw(F.col("other")))).alias("random"))
    kinds = there.join(found.select("query_id", "candidates"), "query_id").join(random, "query_id", "left").select(
        "query_id", "text", "title", "project", F.get("gold", F.lit(0)).alias("correct"), wrong.alias("top_wrong"), "random"
    )
    made = kinds.select("query_id", "text", "title", "project", F.explode(F.array(*[F.struct(F.lit(k).alias("population"), F.col(k).alias("proposal")) for k in ("correct", "top_wrong", "random")])).alias("p"))
    made = settled(made.select("query_id", "text", "title", "project", "p.*").where("proposal is not null"))
    verdicts = verify(made, lexicon, Verification(absolute=0.0, relative=0.0), c, patterns)
    fired = F.exists("reasons", lambda r: F.startswith(r, F.lit("formula pattern match")))
    rated = verdicts.select("query_id", "proposal", "evidence", "rel_evidence", fired.alias("pattern_fired"))
    return made.select("query_id", "project", "population", "proposal").join(rated, ["query_id", "proposal"]).select("project", "population", "evidence", "rel_evidence", "pattern_fired")


def dense_arm(queries: DataFrame, corpus: DataFrame, gold: DataFrame, kind: str, lexical: DataFrame | None = None, depth: int = 200, tail: int = 10, others: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records (query_id, kind, coverage, margin, rank) of dense retrieval, or with ``lexical`` (query_id, id, rk) of both fused by rank.

    coverage is the best cosine, margin the separation of the best score of the ranking
    from its followers; rank is 1 if the best is one of gold (query_id, id), else 0.
    ``others`` leaves out rows that may not answer, such as the query itself.
    """
    near = top_k(queries, corpus, depth + bool(others)).select("query_id", "id", "score", "rk")
    if others:
        near = others(near).withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("rk"))).where(F.col("rk") <= depth)
    best = near.where("rk = 1").select("query_id", F.col("score").alias("coverage"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    rows = near if lexical is None else fuse([near, lexical]).withColumn("rk", F.row_number().over(order))
    top = F.max(F.when(F.col("rk") == 1, F.col("score")))
    margin = separation(top, F.avg(F.when(F.col("rk").between(2, tail), F.col("score"))))
    margins = rows.groupBy("query_id").agg(margin.alias("margin"))
    right = rows.where("rk = 1").join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").select("query_id", F.lit(1).alias("rank"))
    out = queries.select("query_id").distinct().join(best, "query_id", "left").join(margins, "query_id", "left").join(right, "query_id", "left")
    return out.select("query_id", F.lit(kind).alias("kind"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("coverage", "margin")], F.coalesce("rank", F.lit(0)).alias("rank"))
