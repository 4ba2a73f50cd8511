"""Reranking by formula features: corpus weights of features, weighted containment, gated blending.

Features are rows (id, feature); all scores test membership only. Queries have query_id,
documents decl_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Reranking


def feature_rows(rows: DataFrame, key: str, features: Column) -> DataFrame:
    return rows.select(key, F.explode(F.array_distinct(features)).alias("feature"))


def feature_weights(documents: DataFrame, n: int | Column) -> DataFrame:
    """(feature, weight): inverse frequency over ``n`` documents, the largest being 1; the row of feature null is for unseen ones."""
    size = F.lit(n) if isinstance(n, int) else n
    df = documents.groupBy("feature").agg(F.count("*").alias("df")).select("feature", F.log(1 + size / (1 + F.col("df"))).alias("idf"))
    top = df.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("top"))
    unseen = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("feature"), F.log(1 + size).alias("idf"))
    return df.unionByName(unseen).crossJoin(F.broadcast(top)).select("feature", (F.col("idf") / F.col("top")).alias("weight"))


def _weighted(features: DataFrame, weights: DataFrame) -> DataFrame:
    unseen = weights.where("feature is null").agg(F.max("weight").alias("_w0"))
    return features.join(weights.where("feature is not null"), "feature", "left").crossJoin(F.broadcast(unseen)).withColumn("weight", F.coalesce("weight", "_w0")).drop("_w0")


def overlap(pairs: DataFrame, queries: DataFrame, documents: DataFrame, weights: DataFrame, core: str, against: str | None, penalty: float) -> DataFrame:
    """(query_id, decl_id, overlap) for ``pairs``: the weight of a query's core features found in the document, as a share of all of them.

    Features like ``against`` that the document lacks cost ``penalty`` of their weight, if
    it has any such features. Never below 0; 0 for a query without core features.
    """
    q = _weighted(queries, weights)
    mass = q.where(F.col("feature").rlike(core)).groupBy("query_id").agg(F.sum("weight").alias("mass"))
    hits = pairs.select("query_id", "decl_id").join(q, "query_id").join(documents.withColumn("_has", F.lit(True)), ["decl_id", "feature"], "left")
    is_core = F.col("feature").rlike(core)
    is_against = F.col("feature").rlike(against) if against else F.lit(False)
    sums = hits.groupBy("query_id", "decl_id").agg(
        F.sum(F.when(is_core & F.col("_has"), F.col("weight")).otherwise(0.0)).alias("hit"),
        F.sum(F.when(is_against & F.col("_has").isNull(), F.col("weight")).otherwise(0.0)).alias("miss"),
    )
    if against:
        states = documents.where(F.col("feature").rlike(against)).select("decl_id").distinct().withColumn("_states", F.lit(True))
        sums = sums.join(states, "decl_id", "left").withColumn("miss", F.when(F.col("_states"), F.col("miss")).otherwise(0.0))
    out = pairs.select("query_id", "decl_id").join(mass, "query_id", "left").join(sums, ["query_id", "decl_id"], "left")
    value = F.greatest(F.lit(0.0), (F.col("hit") - penalty * F.col("miss")) / F.col("mass"))
    return out.select("query_id", "decl_id", F.coalesce(F.when(F.col("mass") > 0, value), F.lit(0.0)).alias("overlap"))


def skeleton_overlap(pairs: DataFrame, queries: DataFrame, documents: DataFrame, weights: DataFrame, c: Reranking = Reranking()) -> DataFrame:
    return overlap(pairs, queries, documents, weights, "^(app|bi):", "^rel:", c.relation_penalty)


def tree_overlap(pairs: DataFrame, queries: DataFrame, documents: DataFrame, weights: DataFrame, c: Reranking = Reranking()) -> DataFrame:
    return overlap(pairs, queries, documents, weights, "^(L:app|R:app|in:)", "^root:", c.root_penalty)


def pattern_overlap(pairs: DataFrame, queries: DataFrame, documents: DataFrame, weights: DataFrame) -> DataFrame:
    return overlap(pairs, queries, documents, weights, "", None, 0.0)


def rerank(ranked: DataFrame, overlaps: DataFrame, c: Reranking = Reranking(), top: int = 5) -> DataFrame:
    """(query_id, decl_id, final, rk): the share of the best lexical score plus the weighted overlap.

    Overlap counts only for queries whose best candidate reaches the gate. Equal values
    keep their order in ``ranked`` (query_id, decl_id, score, rk).
    """
    all_ = Window.partitionBy("query_id")
    j = ranked.where(F.col("rk") <= c.depth).join(overlaps, ["query_id", "decl_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    weight = F.when(F.max("overlap").over(all_) >= c.gate, c.weight).otherwise(0.0)
    final = F.col("score") / F.max("score").over(all_) + weight * F.col("overlap")
    order = all_.orderBy(F.desc(F.round("final", 9)), "rk0")
    return j.withColumn("final", final).withColumnRenamed("rk", "rk0").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top).select("query_id", "decl_id", "final", "rk")
