"""Auditing proposals: does a declaration that someone names carry a statement's evidence?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Retrieval, Verification
from ..functions.lexical import draw, draw_sql
from ..sources.store import settled
from .lexicon import Lexicon
from .relational import tail
from .retrieve import query_weights, ranked, scores


#: Random proposals are looked for among the names of one of so many slices.
SLICES = 64


def support(pairs: DataFrame, weights: DataFrame, lexicon: Lexicon, c: Verification = Verification()) -> DataFrame:
    """(query_id, decl_id, evidence): the share of a query's weight that a declaration's name and, discounted, its module carry."""
    w = weights.join(lexicon.idf.select("token", "idf"), "token").select("query_id", "token", (F.col("weight") * F.col("idf")).alias("worth"))
    mass = w.groupBy("query_id").agg(F.sum("worth").alias("mass"))
    wanted = pairs.select("query_id", "decl_id").distinct()
    field = F.when(F.col("field") == "name", 1.0).otherwise(c.module_weight)
    hits = wanted.join(lexicon.postings.where("field in ('name', 'mod')"), "decl_id").join(w, ["query_id", "token"]).groupBy("query_id", "decl_id").agg(F.sum(F.col("worth") * field).alias("hit"))
    out = wanted.join(hits, ["query_id", "decl_id"], "left").join(mass, "query_id", "left")
    return out.select("query_id", "decl_id", F.coalesce(F.col("hit") / F.nullif("mass", F.lit(0.0)), F.lit(0.0)).alias("evidence"))


def verify(proposals: DataFrame, lexicon: Lexicon, c: Verification = Verification(), r: Retrieval = Retrieval(), patterns: DataFrame | None = None) -> DataFrame:
    """Verdicts on proposals (query_id, text, title, proposal): query_id, proposal, status, evidence, rel_evidence, pattern, better, reasons.

    ``patterns`` (query_id, proposal, pattern) are pattern overlaps; one that reaches its
    threshold verifies by itself. rel_evidence compares with the best of the retrieved
    rivals and may exceed 1. A name that isn't in the library: nonexistent.
    """
    p = proposals.withColumn("proposal", F.trim("proposal"))
    ids = lexicon.rows.groupBy("name").agg(F.max("decl_id").alias("decl_id"))
    placed = p.select("query_id", "proposal").distinct().join(ids.withColumnRenamed("name", "proposal"), "proposal", "left")
    queries = p.select("query_id", "text", "title").dropDuplicates(["query_id"])
    weights = settled(query_weights(queries, lexicon, r))
    rivals = settled(ranked(scores(weights, lexicon, r), c.rivals).select("query_id", "decl_id", "rk"))
    found = support(placed.where("decl_id is not null").select("query_id", "decl_id").union(rivals.select("query_id", "decl_id")), weights, lexicon, c)
    found = settled(found)
    own = placed.join(found, ["query_id", "decl_id"], "left")
    names = lexicon.rows.select("decl_id", "name")
    rated = rivals.join(found, ["query_id", "decl_id"]).join(names, "decl_id").select("query_id", "rk", "name", F.col("evidence").alias("theirs"))
    best = rated.groupBy("query_id").agg(F.max("theirs").alias("best"), F.array_sort(F.collect_list(F.struct("rk", "name", F.col("theirs").alias("evidence")))).alias("rivals"))
    out = own.join(best, "query_id", "left")
    if patterns is not None:
        out = out.join(patterns.select("query_id", "proposal", "pattern"), ["query_id", "proposal"], "left")
    else:
        out = out.withColumn("pattern", F.lit(None).cast("double"))
    exists, ev = F.col("decl_id").isNotNull(), F.coalesce("evidence", F.lit(0.0))
    by_pattern = exists & F.coalesce(F.col("pattern") >= c.pattern, F.lit(False))
    rel = F.when(~exists, 0.0).when(by_pattern, 1.0).when(F.col("best") > 0, ev / F.col("best")).when(ev > 0, 1.0).otherwise(0.0)
    out = out.select("query_id", "proposal", exists.alias("exists"), by_pattern.alias("_by_pattern"), F.when(exists, ev).otherwise(0.0).alias("evidence"), rel.alias("rel_evidence"), "pattern", "rivals")
    ev, rel = F.col("evidence"), F.col("rel_evidence")
    reasons = F.array_compact(F.array(
        F.when(~F.col("exists"), F.lit("name not found in the library")),
        F.when(F.col("_by_pattern"), F.format_string(f"formula pattern match (%.2f >= {c.pattern})", "pattern")),
        F.when(F.col("exists") & ~F.col("_by_pattern") & (ev < c.absolute), F.format_string(f"absolute evidence %.3f < {c.absolute}", ev)),
        F.when(F.col("exists") & ~F.col("_by_pattern") & (rel < c.relative), F.format_string(f"relative evidence %.3f < {c.relative}", rel)),
    ))
    status = F.when(~F.col("exists"), "nonexistent").when(F.col("_by_pattern") | ((ev >= c.absolute) & (rel >= c.relative)), "verified").otherwise("rejected")
    stronger = F.filter("rivals", lambda x: (x["name"] != F.col("proposal")) & (x["evidence"] > F.greatest(1.5 * ev, ev + 0.08)))
    better = F.transform(F.slice(stronger, 1, 3), lambda x: F.struct(x["name"].alias("name"), F.bround(x["evidence"], 4).alias("evidence")))
    empty = F.array().cast("array<struct<name:string,evidence:double>>")
    return out.select("query_id", "proposal", status.alias("status"), ev, rel, "pattern", F.when(F.col("exists") & ~F.col("_by_pattern"), F.coalesce(better, empty)).otherwise(empty).alias("better"), reasons.alias("reasons"))


def corrupted(gold: DataFrame, library: DataFrame, seed: int = 0) -> DataFrame:
    """Proposals of five kinds for pairs (query_id, name): query_id, population, proposal. Choices go by hash; kinds without a candidate are left out.

    correct: the name; sibling: another name of its module; wrong_namespace: another name
    with its last part; random: any other name; hallucinated: a name that doesn't exist,
    from the namespace of the one and the words of another. A choice is the name nearest
    to a hashed point of the group, so groups are never paired up.
    """
    seed_ = F.lit(seed)
    slice_of = lambda *x: (draw(*x) % SLICES).cast("string")
    lib = library.groupBy("name").agg(F.min("module").alias("module")).select("name", "module", tail(F.col("name")).alias("tail"), slice_of(F.col("name")).alias("any"))

    def chosen(asking: DataFrame, group: str, salt: str) -> DataFrame:
        member = F.when(F.col("query_id").isNull(), F.col("name"))
        point = F.when(F.col("query_id").isNull(), draw(F.col("name"))).otherwise(draw(f"{salt}{seed}", F.col("query_id")))
        asks = asking.select("query_id", "name", F.col(group).alias("g"))
        members = lib.select(F.lit(None).cast(asks.schema["query_id"].dataType).alias("query_id"), "name", F.col(group).alias("g"))
        both = members.union(asks).where("g is not null").withColumn("h", point)
        forth, back = (Window.partitionBy("g").orderBy(o, "query_id", "name").rowsBetween(Window.unboundedPreceding, -1) for o in (F.desc("h"), F.asc("h")))
        ends = both.groupBy("g").agg(F.min_by(member, F.when(member.isNotNull(), F.col("h"))).alias("first"), F.max_by(member, F.when(member.isNotNull(), F.col("h"))).alias("final"))
        near = both.select("query_id", "name", "g", F.last(member, ignorenulls=True).over(forth).alias("after"), F.last(member, ignorenulls=True).over(back).alias("before")).where("query_id is not null")
        unlike = F.coalesce(*[F.when(F.col(x) != F.col("name"), F.col(x)) for x in ("after", "before", "first", "final")])
        return near.join(ends, "g").select("query_id", unlike.alias("proposal")).where("proposal is not null")

    pairs = gold.select("query_id", "name").join(lib.drop("any"), "name", "left").withColumn("any", slice_of(seed_, F.col("query_id")))
    sibling, homonym, random = chosen(pairs, "module", "sibling"), chosen(pairs, "tail", "tail"), chosen(pairs, "any", "random")
    donor = random.select("query_id", F.col("proposal").alias("donor"))
    parts = F.split("name", r"\.")
    made = F.concat(F.element_at(F.split("donor", r"\."), -1), F.lit("_"), F.element_at(F.split(F.element_at(parts, -1), "_"), -1))
    invented = pairs.join(donor, "query_id").select("query_id", F.array_join(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(made)), ".").alias("proposal"))
    known = lib.select(F.col("name").alias("proposal"), F.lit(True).alias("known"))
    invented = invented.join(known, "proposal", "left").select("query_id", F.when(F.col("known"), F.concat("proposal", F.lit("'"))).otherwise(F.col("proposal")).alias("proposal"))
    kinds = {"correct": gold.select("query_id", F.col("name").alias("proposal")), "sibling": sibling, "wrong_namespace": homonym, "random": random, "hallucinated": invented}
    out = [d.select("query_id", F.lit(k).alias("population"), "proposal") for k, d in kinds.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


def corrupted_sql(gold: str, library: str, seed: int = 0) -> str:
    """DuckDB SQL for :func:`corrupted` of two queries in parentheses."""

    def chosen(group: str, salt: str) -> str:
        h, point = draw_sql("l.name"), draw_sql(f"'{salt}{seed}'", "p.query_id")
        near = f"arg_min(l.name, {h}) filter (where {h} >= {point}) as a, arg_max(l.name, {h}) filter (where {h} <= {point}) as b, arg_min(l.name, {h}) as c, arg_max(l.name, {h}) as d"
        return f"(select query_id, coalesce({', '.join(f'case when {x} <> name then {x} end' for x in 'abcd')}) as proposal from (select p.query_id, p.name, {near} from pairs p join lib l on l.{group} = p.{group} group by 1, 2))"

    last = lambda x, by: f"string_split({x}, '{by}')[-1]"
    return f"""
lib as materialized (select name, min(module) as module, {last('name', '.')} as tail, {draw_sql('name')} % {SLICES} as slice from {library} group by 1),
pairs as materialized (select g.query_id, g.name, l.module, l.tail, {draw_sql(str(seed), 'g.query_id')} % {SLICES} as slice from {gold} g left join lib l using (name)),
rand as materialized (select * from {chosen('slice', 'random')}),
made as (select p.query_id, array_to_string(list_append(string_split(p.name, '.')[:-2], {last('r.proposal', '.')} || '_' || {last(last('p.name', '.'), '_')}), '.') as proposal from pairs p join rand r using (query_id) where r.proposal is not null),
corrupted as (select query_id, 'correct' as population, name as proposal from pairs union all select query_id, 'sibling', proposal from {chosen('module', 'sibling')} union all select query_id, 'wrong_namespace', proposal from {chosen('tail', 'tail')}
  union all select query_id, 'random', proposal from rand union all select query_id, 'hallucinated', case when proposal in (select name from lib) then proposal || chr(39) else proposal end from made)"""


def acceptance(verdicts: DataFrame) -> DataFrame:
    """By population: n, accept_rate, caught_nonexistent, pattern_fire_rate, of verdicts with a population."""
    fired = F.exists("reasons", lambda r: F.startswith(r, F.lit("formula pattern match")))
    share = lambda x: F.round(F.avg(x.cast("int")), 3)
    s = F.col("status")
    return verdicts.groupBy("population").agg(F.count("*").alias("n"), share(s == "verified").alias("accept_rate"), share(s == "nonexistent").alias("caught_nonexistent"), share(fired).alias("pattern_fire_rate"))
