"""The library's jobs: scan, build, query, verify, draw, and measure, each over whole batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PROFILES, Reranking, Retrieval
from .functions import formula
from .operators import audit, calibrate, graph, lexicon, relational, retrieve, structure, twins
from .sources import latex, lean, store


def scan(spark: SparkSession, root: str, path: str) -> int:
    """Declarations of a source tree as JSON lines; how many."""
    return store.write_lines(lean.scan_tree(spark, root), path)


def build_index(spark: SparkSession, declarations: DataFrame, path: str, truth: DataFrame | None = None, holdout: float = 0.0, unlearned: float = 0.0) -> lexicon.Lexicon:
    """Twins, words, lexicon, on disk."""
    rows, outcomes = twins.expand(declarations, truth)
    rows = lexicon.with_words(rows.withColumn("decl_id", F.monotonically_increasing_id()))
    rows.write.mode("overwrite").parquet(f"{path}/words")  # ids are settled here
    built, held, blind = lexicon.build(spark.read.parquet(f"{path}/words"), Retrieval().length_pivot, holdout, unlearned)
    return store.save(built, path, truth.select("name").distinct().count() if truth is not None else 0, outcomes, held if holdout else None, blind if unlearned else None)


def setup(spark: SparkSession, sources: dict[str, str], folder: str) -> dict[str, str]:
    """Indexes of the named source trees, each built only if it is stale; where they are."""
    truth = store.ground_truth(spark, folder)
    size = truth.select("name").distinct().count() if truth is not None else 0
    out = {}
    for name, root in sources.items():
        out[name] = f"{folder.rstrip('/')}/index_{name}"
        if store.needs_build(spark, out[name], size):
            build_index(spark, lean.scan_tree(spark, root), out[name], truth)
    return out


def query(queries: DataFrame, lex: lexicon.Lexicon, rerank: str = "struct", top: int = 5, retrieval: Retrieval = Retrieval(), c: Reranking = Reranking()) -> DataFrame:
    """Candidates of queries (query_id, text, title, math): query_id, rk, decl_id, name, score. rerank: none, struct or tree; it never abstains."""
    ranked = retrieve.ranked(retrieve.scores(retrieve.query_weights(queries, lex, retrieval), lex, retrieval), c.depth if rerank != "none" else max(top, retrieval.tail))
    names = lex.rows.select("decl_id", "name")
    if rerank == "none":
        return ranked.where(F.col("rk") <= top).join(names, "decl_id").select("query_id", "rk", "decl_id", "name", "score")
    of_query, of_head, overlap = {
        "struct": (formula.latex_skeleton_features, formula.head_skeleton_features, structure.skeleton_overlap),
        "tree": (formula.latex_tree_features, formula.head_tree_features, structure.tree_overlap),
    }[rerank]
    docs = structure.feature_rows(lex.rows.where("head <> ''"), "decl_id", of_head("head"))
    weights = structure.feature_weights(docs, lex.rows.count())
    pairs = ranked.select("query_id", "decl_id")
    overlaps = overlap(pairs, structure.feature_rows(queries, "query_id", of_query("math")), docs, weights, c)
    return structure.rerank(ranked, overlaps, c, top).join(names, "decl_id").select("query_id", "rk", "decl_id", "name", F.col("final").alias("score"))


def verify(proposals: DataFrame, lex: lexicon.Lexicon, profile: str = "permissive", retrieval: Retrieval = Retrieval()) -> DataFrame:
    """Verdicts on (query_id, text, title, math, proposal) under a named profile."""
    docs = structure.feature_rows(lex.rows.where("head <> ''"), "decl_id", formula.head_pattern_features("head"))
    weights = structure.feature_weights(docs, lex.rows.count())
    ids = lex.rows.groupBy("name").agg(F.max("decl_id").alias("decl_id")).withColumnRenamed("name", "proposal")
    pairs = proposals.select("query_id", F.trim("proposal").alias("proposal")).join(ids, "proposal")
    asked = structure.feature_rows(proposals.dropDuplicates(["query_id"]), "query_id", formula.latex_pattern_features("math"))
    patterns = structure.pattern_overlap(pairs.select("query_id", "decl_id").distinct(), asked, docs, weights).join(pairs, ["query_id", "decl_id"]).select("query_id", "proposal", F.col("overlap").alias("pattern"))
    return audit.verify(proposals, lex, PROFILES[profile], retrieval, patterns)


def draw(spark: SparkSession, paths: list[str], lex: lexicon.Lexicon | None = None) -> graph.Graph:
    """The graph of a paper, its claims aligned if there is a lexicon."""
    return graph.build(latex.read_paper(spark, paths), lex)


def measure(queries: DataFrame, gold: DataFrame, lex: lexicon.Lexicon, rerank: str = "struct") -> DataFrame:
    """Recall and reciprocal rank of queries against gold names (query_id, name)."""
    found = query(queries, lex, rerank, 5)
    ids = gold.join(lex.rows.select("name", F.col("decl_id").alias("id")), "name").select("query_id", "id")
    return calibrate.rank_report(calibrate.gold_rank(found.select("query_id", F.col("decl_id").alias("id"), "rk"), ids))


def measure_verifier(statements: DataFrame, gold: DataFrame, lex: lexicon.Lexicon, profile: str = "permissive", seed: int = 0) -> DataFrame:
    """Acceptance by population of proposals made from gold names (query_id, name) of statements (query_id, text, title, math)."""
    made = audit.corrupted(gold, lex.rows, seed)
    asked = made.join(statements, "query_id").withColumn("query_id", F.concat_ws("|", "population", F.col("query_id").cast("string")))
    verdicts = verify(asked, lex, profile).withColumn("population", F.split_part("query_id", F.lit("|"), F.lit(1)))
    return audit.acceptance(verdicts)


def annotated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Statements of a paper that name their declarations, of five words or more: query_id, text, title, math, targets."""
    blocks = latex.read_paper(spark, paths)
    said = blocks.where((F.size("declared_lean") > 0) & (F.col("kind") != "proof") & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 5))
    return said.select(F.concat_ws("|", "path", "id").alias("query_id"), "text", "title", "math", F.col("declared_lean").alias("targets"))


def _gold(statements: DataFrame, lex: lexicon.Lexicon) -> DataFrame:
    """(query_id, name): the first target that the library has."""
    return relational.first_known(statements, "query_id", "targets", lex.rows.select("name").distinct(), "name")


def bench(statements: DataFrame, lex: lexicon.Lexicon) -> DataFrame:
    """Recall of annotated statements whose declarations the library has, without and with reranking by structure: ranking, n, recall_1, recall_5."""
    gold = statements.select("query_id", F.explode("targets").alias("name")).join(lex.rows.select("name").distinct(), "name", "left_semi")
    asked = statements.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    rows = [measure(asked, gold, lex, kind).select(F.lit(name).alias("ranking"), "n", F.round("recall_1", 3).alias("recall_1"), F.round("recall_5", 3).alias("recall_5")) for name, kind in (("lexical", "none"), ("+structural", "struct"))]
    return rows[0].union(rows[1])


def verify_bench(statements: DataFrame, lex: lexicon.Lexicon, seed: int = 0, patterns: bool = False) -> DataFrame:
    """Acceptance of proposals of five kinds for annotated statements, by profile and population; formulas count only with ``patterns``."""
    gold = _gold(statements, lex)
    asked = statements if patterns else statements.withColumn("math", F.array().cast("array<string>"))
    rows = [measure_verifier(asked.select("query_id", "text", "title", "math"), gold, lex, profile, seed).select(F.lit(profile).alias("profile"), "*") for profile in ("permissive", "precise")]
    return rows[0].union(rows[1])


def elaborate(spark: SparkSession, dump: str, source: str, path: str) -> lexicon.Lexicon:
    """The index of a dump of elaborated declarations, with the docstrings of its source tree; making the dump is the prover's own work."""
    return build_index(spark, lean.carry_docs(lean.read_dump(spark, dump), lean.scan_tree(spark, source)), path)


def graph_retrieval(retrieval: Retrieval, tau: float, delta: float) -> Retrieval:
    return replace(retrieval, coverage=tau, margin=delta)
