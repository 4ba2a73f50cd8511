"""Every operator as a query over the driver's tables, beside SQL that gives the same rows.

Documents stand in for declarations (their words for names, source and lang for the two
other fields), benchmark items for informal queries, labels for the arms of an evaluation.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Reranking, Retrieval, Verification
from ..functions import formula, lexical, markup
from ..operators import arms, audit, calibrate, graph, lexicon, relational, retrieve, structure, twins, vectors
from ..sources import latex, lean, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def six(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- shared stand-ins

SETTINGS = Retrieval()
MATCH_SET = lexical.prose_words_sql("coalesce(text, '')")
LIB = f"""
w as materialized (select doc_id as decl_id, unnest(list_distinct({MATCH_SET})) as token from documents),
mo as materialized (select doc_id as decl_id, lower(source) as token from documents where source is not null),
ty as materialized (select doc_id as decl_id, lower(lang) as token from documents where lang is not null),
posted as materialized (select 'name' as field, token, decl_id from w union all select 'mod', token, decl_id from (select decl_id, token from mo except select decl_id, token from w)
  union all select 'typ', token, decl_id from (select decl_id, token from ty except select decl_id, token from w)),
n as materialized (select count(*) as n, greatest(floor(count(*) * {SETTINGS.max_df_share}), {SETTINGS.max_df_least}) as max_df from documents),
df as materialized (select token, count(distinct decl_id) as df from (select * from w union all select * from mo union all select * from ty) group by token),
idf as materialized (select token, df, ln(1 + n / (1 + df)) as idf from df, n),
sizes as materialized (select token, count(*) filter (where field = 'name') as n_name, count(*) filter (where field = 'mod') as n_mod, count(*) filter (where field = 'typ') as n_typ from posted group by token),
admitted as materialized (select i.token, i.idf, s.n_name, s.n_mod, s.n_typ, n.max_df from idf i join sizes s using (token), n where s.n_name <= n.max_df or s.n_mod > 0 or s.n_typ > 0),
lens as materialized (select d.doc_id as decl_id, case when coalesce(sum(i.idf), 0) = 0 then 1.0 else sum(i.idf) end as len from documents d left join w on w.decl_id = d.doc_id left join idf i on i.token = w.token group by d.doc_id),
norms as materialized (select decl_id, len, {1 - SETTINGS.length_pivot} + {SETTINGS.length_pivot} * len / (select avg(len) from lens) as lennorm from lens)"""
PMI = f"""
pt as materialized (select decl_id, token from (select * from mo union select * from ty) where decl_id in (select decl_id from w)),
cw as materialized (select token as word, count(*) as cw from w group by 1), ct as materialized (select token, count(*) as ct from pt group by 1),
tot as materialized (select sum(a.k * b.k) as total from (select decl_id, count(*) as k from w group by 1) a join (select decl_id, count(*) as k from pt group by 1) b using (decl_id)),
pc as materialized (select w.token as word, pt.token, count(*) as c from w join pt using (decl_id) group by 1, 2),
pm as (select word, token, ln(c * total / (cw * ct) + 1e-12) as pmi, c from pc join cw using (word) join ct using (token), tot where c >= 5 and cw >= 4 and ct >= 4),
pr as (select word, token, pmi * c / (c + 25.0) as raw from pm where pmi > 0),
pk as (select word, token, raw, row_number() over (partition by word order by round(raw, 9) desc, token) as rk from pr),
trans as materialized (select word, token, raw / max(raw) over (partition by word) as weight, rk from pk where rk <= 12)"""
ASKED = f"""
adm as materialized (select *, {lexical.stem_sql("token")} as st, left(token, 4) as pre from admitted),
qw as materialized (select distinct item_id as query_id, unnest({MATCH_SET}) as word from benchmark),
own as materialized (select q.query_id, q.word, i.idf as src from qw q left join idf i on i.token = q.word),
hops as (
  select query_id, word as token, 1.0 as w, cast(null as double) as src, 'literal' as hop from own
  union all select query_id, a.token, {SETTINGS.stem_weight}, src, 'stem' from own join adm a on a.st = own.word
  union all select query_id, a.token, {SETTINGS.prefix_weight}, src, 'prefix' from own join adm a on a.pre = left(own.word, 4)
    where length(own.word) >= 5 and length(a.token) between 4 and 9 and a.token <> own.word and (starts_with(own.word, a.token) or starts_with(a.token, left(own.word, 5)))
  union all select query_id, t.token, {SETTINGS.expansion_weight} * t.weight, src, 'translation' from own join trans t using (word) where t.rk <= {SETTINGS.expansions}),
expanded as materialized (select query_id, token, hop, w * case when a.idf > src then src / a.idf else 1.0 end as weight from hops join admitted a using (token)),
weights as materialized (select query_id, token, max(weight) as weight from expanded group by 1, 2)"""
SCORED = f"""
used as materialized (select query_id, token, weight * idf as worth, n_name > 0 as a, n_mod > 0 and n_mod <= {SETTINGS.field_cap} * max_df as b, n_typ > 0 and n_typ <= {SETTINGS.field_cap} * max_df as c from weights join admitted using (token)),
mass as materialized (select query_id, sum(worth * greatest(case when a then 1.0 else 0 end, case when b then {SETTINGS.module_weight} else 0 end, case when c then {SETTINGS.type_weight} else 0 end)) as mass from used group by 1),
raws as materialized (select query_id, decl_id, sum(worth * case field when 'name' then 1.0 when 'mod' then {SETTINGS.module_weight} else {SETTINGS.type_weight} end) as raw
  from used join posted using (token) where (field = 'name' and a) or (field = 'mod' and b) or (field = 'typ' and c) group by 1, 2),
scored as materialized (select query_id, decl_id, raw, raw / lennorm as score, mass from raws join norms using (decl_id) join mass using (query_id) where mass > 0),
ranked as materialized (select *, row_number() over (partition by query_id order by round(score, 9) desc, decl_id) as rk from scored)"""


def library(spark: SparkSession, d: str) -> DataFrame:
    """Documents as declarations."""
    one = lambda c: F.array_compact(F.array(F.lower(c)))
    words = lexical.prose_word_set(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("decl_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("module"), words.alias("tokens"), one("source").alias("mod_tokens"), one("lang").alias("typ_tokens"))


def lexicon_of(spark: SparkSession, d: str, keep: str = "true") -> lexicon.Lexicon:
    """The lexicon of the documents that ``keep`` holds for, built once a session; later queries read its tables."""
    saved = lambda name, build: store.once(spark, f"{d}|{keep}|{name}", build)
    rows = saved("rows", lambda: library(spark, d).where(keep))
    posted = saved("postings", lambda: lexicon.postings(rows))
    idf = saved("idf", lambda: lexicon.inverse_frequency(lexicon.document_frequency(rows, "tokens", "mod_tokens", "typ_tokens"), rows).join(lexicon.posting_sizes(posted), "token", "left").fillna(0, ["n_name", "n_mod", "n_typ"]))
    norms = saved("norms", lambda: lexicon.length_norms(rows, idf, SETTINGS.length_pivot))
    learned = saved("translations", lambda: lexicon.translation_table(rows, F.col("tokens"), F.array_union("mod_tokens", "typ_tokens")))
    return lexicon.Lexicon(rows, idf, posted, norms, learned)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit(None).cast("string").alias("title"))


# --- words


@query(f"select p_partkey, array_to_string({lexical.identifier_words_sql('p_name')}, ' ') as name_words, array_to_string({lexical.identifier_words_sql('p_brand')}, ' ') as brand_words from part")
def identifier_tokens(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(lexical.identifier_words(F.col("p_name")), " ").alias("name_words"), F.array_join(lexical.identifier_words(F.col("p_brand")), " ").alias("brand_words"))


@query(f"with w as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from documents) select word, {lexical.stem_sql('word')} as stem from w")
def light_stem_vocab(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), F.lower))).alias("word")).distinct()
    return words.select("word", lexical.stem(F.col("word")).alias("stem"))


@query(f"with w as (select doc_id, {MATCH_SET} as ws from documents) select doc_id, len(ws)::bigint as n_words, len(list_distinct(ws))::bigint as n_distinct, ws[1] as first_word from w")
def prose_words_per_doc(spark, d):
    w = table(spark, d, "documents").select("doc_id", lexical.prose_words(F.coalesce("text", F.lit(""))).alias("ws"))
    return w.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"), F.get("ws", F.lit(0)).alias("first_word"))


HEAD_SQL = "concat('theorem ', replace(p_name, ' ', '_'), ' [T2Space u_1] {x : ', p_type, '} (hs : Is', replace(p_brand, '#', '_'), ' x) : isFoo', p_size, ' ', p_name, ' := by simp')"


def part_heads(spark: SparkSession, d: str) -> DataFrame:
    """Parts as declaration heads."""
    text = F.concat(F.lit("theorem "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" [T2Space u_1] {x : "), "p_type", F.lit("} (hs : Is"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" x) : isFoo"), F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit(" := by simp"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("head"))


@query(f"select p_partkey as id, array_to_string({lexical.head_words_sql(HEAD_SQL)}, ' ') as words from part")
def type_words(spark, d):
    return part_heads(spark, d).select("id", F.array_join(lexical.head_words(F.col("head")), " ").alias("words"))


# --- lexicon


@query(f"with {LIB} select token, df from df")
def token_document_frequency(spark, d):
    return lexicon.document_frequency(library(spark, d), "tokens", "mod_tokens", "typ_tokens")


@query(f"with {LIB} select token, df, round(idf, 6) as idf from idf")
def token_idf(spark, d):
    rows = library(spark, d)
    return lexicon.inverse_frequency(lexicon.document_frequency(rows, "tokens", "mod_tokens", "typ_tokens"), rows).select("token", "df", six("idf").alias("idf"))


@query(f"with {LIB} select field, token, count(*) as n, min(decl_id) as first, max(decl_id) as last from posted group by 1, 2")
def postings_by_token(spark, d):
    return lexicon.postings(library(spark, d)).groupBy("field", "token").agg(F.count("*").alias("n"), F.min("decl_id").alias("first"), F.max("decl_id").alias("last"))


@query(f"with {LIB} select field, decl_id, count(*) as n from posted group by 1, 2")
def field_disjoint_postings(spark, d):
    return lexicon.postings(library(spark, d)).groupBy("field", "decl_id").agg(F.count("*").alias("n"))


@query(f"with {LIB} select decl_id, round(len, 6) as len, round(lennorm, 6) as lennorm from norms")
def doc_length_norm(spark, d):
    rows = library(spark, d)
    idf = lexicon.inverse_frequency(lexicon.document_frequency(rows, "tokens", "mod_tokens", "typ_tokens"), rows)
    return lexicon.length_norms(rows, idf, SETTINGS.length_pivot).select("decl_id", six("len").alias("len"), six("lennorm").alias("lennorm"))


@query(f"with {LIB}, {PMI} select word, token, round(weight, 6) as weight, rk from trans")
def pmi_translation(spark, d):
    learned = lexicon.translation_table(library(spark, d), F.col("tokens"), F.array_union("mod_tokens", "typ_tokens"))
    return learned.select("word", "token", six("weight").alias("weight"), "rk")


@query(f"with {LIB} select token, n_name, n_mod, n_typ from admitted")
def df_admission_filter(spark, d):
    return retrieve.admitted(lexicon_of(spark, d)).select("token", "n_name", "n_mod", "n_typ")


@query("select coalesce(source, 'source') as provenance, count(*) as n from documents group by 1")
def provenance_histogram(spark, d):
    return lexicon.provenance_counts(table(spark, d, "documents").withColumnRenamed("source", "provenance"))


# --- retrieval


def _hop(*names: str):
    def run(spark, d):
        lex = lexicon_of(spark, d)
        found = retrieve.expansions(retrieve.query_words(asked(spark, d)), lex).where(F.col("hop").isin(*names))
        return found.groupBy("query_id", "token", "hop").agg(six(F.max("weight")).alias("weight"))

    return run


for _name, _hops in (("query_expand_literal_stem", ("literal", "stem")), ("query_expand_prefix", ("prefix",)), ("query_expand_translation", ("translation",))):
    QUERIES[_name] = _hop(*_hops)
    ORACLES[_name] = f"with {LIB}, {PMI}, {ASKED} select query_id, token, hop, round(max(weight), 6) as weight from expanded where hop in ({', '.join(repr(h) for h in _hops)}) group by 1, 2, 3"


@query(f"with {LIB}, {PMI}, {ASKED} select query_id, token, round(weight, 6) as weight from weights")
def query_weights(spark, d):
    return retrieve.query_weights(asked(spark, d), lexicon_of(spark, d)).select("query_id", "token", six("weight").alias("weight"))


@query(f"with {LIB} select distinct q.query_id, i.token from (select item_id as query_id, unnest({MATCH_SET}) as word from benchmark) q join (select token, token as word from idf union select token, {lexical.stem_sql('token')} from idf) i using (word)")
def direct_tokens(spark, d):
    return retrieve.direct_tokens(asked(spark, d), lexicon_of(spark, d))


@query(f"with {LIB}, {PMI}, {ASKED}, {SCORED} select query_id, decl_id, rk, round(score, 6) as score from ranked where rk <= 10")
def sparse_score_topk(spark, d):
    lex = lexicon_of(spark, d)
    top = retrieve.ranked(retrieve.scores(store.settled(retrieve.query_weights(asked(spark, d), lex)), lex), 10)
    return top.select("query_id", "decl_id", "rk", six("score").alias("score"))


ALIGNED = f"""
al as (select query_id, max(case when rk = 1 then raw / mass end) as coverage, coalesce((max(case when rk = 1 then score end) - avg(case when rk between 2 and 10 then score end)) / max(case when rk = 1 then score end), 1.0) as margin,
  max(case when rk = 1 then decl_id end) as best from ranked where rk <= 10 group by 1)"""


@query(
    f"with {LIB}, {PMI}, {ASKED}, {SCORED}, {ALIGNED} select b.item_id as query_id, case when coalesce(coverage, 0) < {SETTINGS.coverage} then 'unmatched' when margin < {SETTINGS.margin} then 'ambiguous' else 'matched' end as status, "
    "round(coalesce(coverage, 0), 6) as coverage, round(coalesce(margin, 0), 6) as margin, best from (select item_id from benchmark union all values (-1), (-2)) b left join al on al.query_id = b.item_id"
)
def align_status(spark, d):
    empty = spark.createDataFrame([(-1, "", None), (-2, "there is the theorem that shows", None)], "query_id long, text string, title string")
    out = retrieve.align(asked(spark, d).unionByName(empty), lexicon_of(spark, d))
    return out.select("query_id", "status", six("coverage").alias("coverage"), six("margin").alias("margin"), F.get("candidates", F.lit(0))["decl_id"].alias("best"))


@query("with s as (select l_orderkey, l_quantity as x, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as rk from lineitem) select l_orderkey, round(coalesce((max(case when rk = 1 then x end) - avg(case when rk between 2 and 10 then x end)) / max(case when rk = 1 then x end), 1.0), 6) as margin from s group by 1")
def separation_statistic(spark, d):
    from pyspark.sql import Window

    rk = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber"))
    s = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), rk.alias("rk"))
    g = s.groupBy("l_orderkey").agg(F.max(F.when(F.col("rk") == 1, F.col("x"))).alias("top"), F.avg(F.when(F.col("rk").between(2, 10), F.col("x"))).alias("tail"))
    return g.select("l_orderkey", six(retrieve.separation(F.col("top"), F.col("tail"))).alias("margin"))


# --- audit

PROPOSED = "prop as (select item_id as query_id, 'd' || cast(item_id * 7 as varchar) as proposal, item_id * 7 as decl_id from benchmark)"
EVIDENCE = """
qm as (select query_id, sum(weight * idf) as mass from weights join idf using (token) group by 1),
pairs as (select query_id, decl_id from prop union select query_id, decl_id from ranked where rk <= 8),
hit as (select query_id, decl_id, sum(weight * idf * case field when 'name' then 1.0 else 0.3 end) as hit from pairs join posted using (decl_id) join weights using (query_id, token) join idf using (token) where field in ('name', 'mod') group by 1, 2),
ev as (select query_id, decl_id, coalesce(hit / mass, 0) as evidence from pairs left join hit using (query_id, decl_id) left join qm using (query_id))"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).withColumn("proposal", F.concat(F.lit("d"), (F.col("query_id") * 7).cast("string")))


@query(f"with {LIB}, {PMI}, {ASKED}, {PROPOSED}, ranked as (select 0 as query_id, 0 as decl_id, 99 as rk), {EVIDENCE} select query_id, decl_id, round(evidence, 6) as evidence from ev join (select distinct query_id from prop) using (query_id) where decl_id in (select decl_id from prop p where p.query_id = ev.query_id)")
def support_evidence(spark, d):
    lex = lexicon_of(spark, d)
    pairs = asked(spark, d).select("query_id", (F.col("query_id") * 7).alias("decl_id"))
    return audit.support(pairs, store.settled(retrieve.query_weights(asked(spark, d), lex)), lex).select("query_id", "decl_id", six("evidence").alias("evidence"))


@query(
    f"with {LIB}, {PMI}, {ASKED}, {SCORED}, {PROPOSED}, {EVIDENCE}, best as (select query_id, max(evidence) as best from ev join (select query_id, decl_id from ranked where rk <= 8) using (query_id, decl_id) group by 1), "
    "v as (select p.query_id, p.proposal, d.doc_id is not null as there, coalesce(e.evidence, 0) as evidence, case when best > 0 then e.evidence / best when e.evidence > 0 then 1.0 else 0.0 end as rel from prop p left join documents d on d.doc_id = p.decl_id left join ev e on e.query_id = p.query_id and e.decl_id = p.decl_id left join best b on b.query_id = p.query_id) "
    "select query_id, proposal, case when not there then 'nonexistent' when evidence >= 0.05 and rel >= 0.35 then 'verified' else 'rejected' end as status, round(case when there then evidence else 0 end, 6) as evidence, round(case when there then rel else 0 end, 6) as rel_evidence from v"
)
def verify_verdict(spark, d):
    out = audit.verify(proposals(spark, d), lexicon_of(spark, d), Verification())
    return out.select("query_id", "proposal", "status", six("evidence").alias("evidence"), six("rel_evidence").alias("rel_evidence"))


@query("with b as (select p_brand, list_sort(list_distinct(list(p_name))) as s from part group by 1) select p_name as name, min(case when s[1] = p_name then s[2] else s[1] end) as sibling from part join b using (p_brand) where len(s) > 1 group by 1")
def corrupt_siblings(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return relational.siblings(p, "brand").groupBy("name").agg(F.min("sibling").alias("sibling"))


_PART_LIB = "(select concat_ws('.', replace(p_brand, '#', ''), replace(p_name, ' ', '_')) as name, p_brand as module, p_partkey from part)"


@query(f"with {audit.corrupted_sql(f'(select min(p_partkey) as query_id, name from {_PART_LIB} group by name)', _PART_LIB)} select query_id, population, proposal from corrupted where proposal is not null")
def corrupted_proposals(spark, d):
    p = table(spark, d, "part")
    lib = p.select(F.concat_ws(".", F.regexp_replace("p_brand", "#", ""), F.regexp_replace("p_name", " ", "_")).alias("name"), F.col("p_brand").alias("module"))
    gold = p.groupBy(F.concat_ws(".", F.regexp_replace("p_brand", "#", ""), F.regexp_replace("p_name", " ", "_")).alias("name")).agg(F.min("p_partkey").alias("query_id"))
    return audit.corrupted(gold, lib)


@query("select population, count(*) as n, round(avg(case when fired or (ev >= 0.3 and rel >= 0.4) then 1 else 0 end), 6) as rate from (select case when quality = 1 then 'correct' when toxic = 1 then 'top_wrong' else 'random' end as population, (doc_id * 37 % 101) / 100.0 as ev, (doc_id * 53 % 97) / 96.0 as rel, doc_id % 29 = 0 as fired from labels) group by 1")
def accept_rate_by_population(spark, d):
    return calibrate.accept_rates(verifier_records(spark, d), 0.3, 0.4).select("population", "n", six("rate").alias("rate"))


def verifier_records(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")  # noqa: E741
    population = F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "top_wrong").otherwise("random")
    return l.select(F.lit("p").alias("project"), population.alias("population"), (F.col("doc_id") * 37 % 101 / 100.0).alias("evidence"), (F.col("doc_id") * 53 % 97 / 96.0).alias("rel_evidence"), (F.col("doc_id") % 29 == 0).alias("pattern_fired"))


@query("""with r as (select case when quality = 1 then 'correct' when toxic = 1 then 'top_wrong' else 'random' end as population, (doc_id * 37 % 101) / 100.0 as ev, (doc_id * 53 % 97) / 96.0 as rel, doc_id % 29 = 0 as fired from labels),
ta as (select distinct round(ev, 4) as ta from r where population = 'correct'), tr as (select distinct round(rel, 4) as tr from r where population = 'correct'),
base as (select population, avg(case when fired or (ev >= 0.5 and rel >= 0.5) then 1.0 else 0 end) as base from r group by 1),
g as (select ta, tr, population, avg(case when fired or (ev >= ta and rel >= tr) then 1.0 else 0 end) as rate from ta, tr, r group by 1, 2, 3),
ok as (select ta, tr, max(case when population = 'correct' then rate end) as rate, bool_and(case when population = 'correct' then rate > base else rate <= base end) as ok from g join base using (population) group by 1, 2)
select round(ta, 6)::double as tau_abs, round(tr, 6)::double as tau_rel, round(rate, 6)::double as rate from ok where ok order by ok.rate desc, ta, tr limit 1""")
def dominating_thresholds(spark, d):
    best = calibrate.dominating(verifier_records(spark, d), 0.5, 0.5)
    return best.select(six("tau_abs").alias("tau_abs"), six("tau_rel").alias("tau_rel"), six("rate").alias("rate"))


# --- arms of an evaluation: a benchmark item's targets are two documents, of which a small library lacks some

STATEMENTS = "select item_id, text, [item_id * 53, item_id * 31] as targets from benchmark"
_RESULT = f"case when coalesce(coverage, 0) < {SETTINGS.coverage} then 'unmatched' when margin < {SETTINGS.margin} then 'ambiguous' else 'matched' end as status, round(coalesce(coverage, 0), 6) as coverage, round(coalesce(margin, 0), 6) as margin, coalesce(rank, 0)::bigint as rank"


def _arm_sql(statements: str, kind: str, documents: str = "", where: str = "true", tail: str = "") -> str:
    """Records of statements (item_id, text, targets) against the library of ``documents``; ``tail`` reads them, as arm, instead."""
    own = f"documents as ({documents}), " if documents else ""
    last = tail or "select query_id, kind, status, coverage, margin, rank from arm"
    return f"""with {own}st as (select * from ({statements}) where {where}), benchmark as (select item_id, text from st), {LIB}, {PMI}, {ASKED}, {SCORED}, {ALIGNED},
tg as (select item_id as query_id, unnest(targets) as decl_id from st), target as (select query_id, min(rk) as rank from ranked join tg using (query_id, decl_id) where rk <= {arms.DEPTH} group by 1),
arm as (select st.item_id as query_id, '{kind}' as kind, {_RESULT} from st left join al on al.query_id = st.item_id left join target on target.query_id = st.item_id)
{last}"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    name = lambda n: F.concat(F.lit("d"), (F.col("query_id") * n).cast("string"))
    return asked(spark, d).withColumn("targets", F.array(name(53), name(31)))


def _rounded(r: DataFrame) -> DataFrame:
    return r.select("query_id", "kind", "status", six("coverage").alias("coverage"), six("margin").alias("margin"), F.col("rank").cast("long").alias("rank"))


_EVEN = "select * from main.documents where doc_id % 2 = 0"
_POS, _NEG = "exists (select 1 from documents where list_contains(targets, doc_id))", "not exists (select 1 from documents where list_contains(targets, doc_id))"


@query(
    f"select * from ({_arm_sql('select doc_id as item_id, left(text, 200) as text, [doc_id] as targets from main.documents where doc_id % 50 = 0 and text is not null', 'pos')}) union all "
    f"select * from ({_arm_sql('select -1 - item_id as item_id, text, []::bigint[] as targets from main.benchmark', 'neg')})"
)
def docstring_arms(spark, d):
    known = table(spark, d, "documents").where("doc_id % 50 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.left("text", F.lit(200)).alias("text"))
    unseen = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("query_id"), F.lit("").alias("name"), "text")
    return _rounded(arms.docstring_arms(known, unseen, lexicon_of(spark, d)))


@query(f"select * from ({_arm_sql(STATEMENTS, 'pos')}) union all select * from ({_arm_sql(STATEMENTS, 'neg', _EVEN, _NEG)})")
def paper_arms(spark, d):
    return _rounded(arms.paper_arms(statements(spark, d), lexicon_of(spark, d), lexicon_of(spark, d, "decl_id % 2 = 0")))


@query(_arm_sql(STATEMENTS, "pos", "", _POS, "select count(*) as n, round(avg(case when rank = 1 then 1 else 0 end), 3) as recall_1, round(avg(case when rank > 0 then 1 else 0 end), 3) as recall_5, round(avg(case when status <> 'unmatched' then 1 else 0 end), 3) as answered from arm"))
def present_arm(spark, d):
    return arms.present_arm(statements(spark, d), lexicon_of(spark, d))[1]


@query(_arm_sql(STATEMENTS, "neg", _EVEN, _NEG, "select count(*) as n, round(avg(case when status <> 'matched' then 1 else 0 end), 3) as correct_abstention, round(avg(case when status = 'matched' then 1 else 0 end), 3) as false_match_rate, count(*) filter (where status = 'matched') as matched, count(*) filter (where status = 'ambiguous') as ambiguous, count(*) filter (where status = 'unmatched') as unmatched from arm"))
def absent_arm(spark, d):
    return arms.absent_arm(statements(spark, d), lexicon_of(spark, d, "decl_id % 2 = 0"))[1]


@query(_arm_sql(STATEMENTS, "pos", "", _POS, f"select count(*) as n, count(r) as reached, round(count(r) / count(*), 6) as reach_rate, quantile_cont(r, 0.5) as median_rank from (select st.item_id, min(rk) as r from st left join (select * from ranked join tg using (query_id, decl_id) where rk <= {Reranking().depth}) h on h.query_id = st.item_id group by 1)"))
def pool_reach(spark, d):
    return arms.pool_reach(statements(spark, d), lexicon_of(spark, d), Reranking().depth).select("n", "reached", six("reach_rate").alias("reach_rate"), "median_rank")


_DRAWN, _POINT = lexical.draw_sql("'d' || doc_id"), lexical.draw_sql("'random0'", "item_id")
_MADE = f"""sl as materialized (select doc_id, {_DRAWN} as h from documents), kn as (select query_id, list(decl_id order by pos) as gold from (select item_id as query_id, unnest(targets) as decl_id, unnest(range(len(targets))) as pos from st) where decl_id in (select doc_id from documents) group by 1),
rnd as (select item_id as query_id, coalesce(arg_min(doc_id, h) filter (where h >= {_POINT}), arg_min(doc_id, h)) as decl_id from st join sl on h % {audit.SLICES} = {_POINT} % {audit.SLICES} group by 1),
mine as (select query_id, 'correct' as population, gold[1] as decl_id from kn union all select query_id, 'top_wrong', arg_min(decl_id, rk) from ranked join kn using (query_id) where rk <= {arms.DEPTH} and not list_contains(gold, decl_id) group by 1 union all select query_id, 'random', decl_id from rnd),
prop as (select distinct query_id, 'd' || decl_id as proposal, decl_id from mine), {EVIDENCE}, best as (select query_id, max(evidence) as best from ev join (select query_id, decl_id from ranked where rk <= 8) using (query_id, decl_id) group by 1)"""


@query(_arm_sql(STATEMENTS, "pos", "", _POS, "select population, count(*) as n, round(avg(evidence), 6) as evidence, round(avg(case when best > 0 then evidence / best when evidence > 0 then 1.0 else 0.0 end), 6) as rel_evidence from mine left join ev using (query_id, decl_id) left join best using (query_id) group by 1").replace("\nselect population", f", {_MADE}\nselect population"))
def verifier_arms(spark, d):
    r = arms.verifier_arms(statements(spark, d).withColumn("project", F.lit("p")), lexicon_of(spark, d))
    return r.groupBy("population").agg(F.count("*").alias("n"), six(F.avg("evidence")).alias("evidence"), six(F.avg("rel_evidence")).alias("rel_evidence"))


@query(f"with {LIB}, {PMI}, {ASKED}, known as (select token from admitted where n_name <= max_df), sw as (select query_id, word as token, 0.9 as weight from qw union all select query_id, t.token, 0.8 * t.weight from qw join trans t using (word) where t.rk <= 6) select query_id, token, round(max(weight), 6) as weight from sw join known using (token) group by 1, 2")
def symbol_query_weights(spark, d):
    lex = lexicon_of(spark, d)
    symbols = retrieve.query_words(asked(spark, d)).select("query_id", F.concat(F.lit("m:"), "word").alias("symbol"))
    learned = lex.translations.withColumn("word", F.concat(F.lit("m:"), "word"))
    return retrieve.symbol_weights(symbols, learned, lex).select("query_id", "token", six("weight").alias("weight"))


# --- structure: the tags of a page are its features, the first page of a host the document

PAGES = "p as (select page_id, regexp_extract(url, '//([^/]+)', 1) as host, list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1)) as tags, list_distinct(regexp_extract_all(html, '&[a-z]+;')) as marks from pages)"
FEATURES = "f as (select page_id, 'app:' || unnest(tags) as feature from p union select page_id, 'rel:' || unnest(marks) from p), fw as (select feature, ln(1 + (select count(*) from pages) / (1 + count(*))) as idf from f group by 1), fm as (select max(idf) as top from fw)"


def page_features(spark: SparkSession, d: str) -> DataFrame:
    tags = F.transform(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1), lambda t: F.concat(F.lit("app:"), t))
    marks = F.transform(F.regexp_extract_all("html", F.lit("&[a-z]+;"), 0), lambda t: F.concat(F.lit("rel:"), t))
    return structure.feature_rows(table(spark, d, "pages"), "page_id", F.concat(tags, marks))


def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    return p.join(p.groupBy("host").agg(F.min("page_id").alias("decl_id")), "host").select(F.col("page_id").alias("query_id"), "decl_id")


@query(f"with {PAGES}, {FEATURES} select feature, round(idf / top, 6) as weight from fw, fm union all select null, round(ln(1 + count(*)) / (select top from fm), 6) from pages")
def feature_idf(spark, d):
    f = page_features(spark, d)
    return structure.feature_weights(f, table(spark, d, "pages").count()).select("feature", six("weight").alias("weight"))


@query(f"""with {PAGES}, {FEATURES}, pr as (select a.page_id as query_id, min(b.page_id) as decl_id from p a join p b using (host) group by 1),
x as (select pr.query_id, pr.decl_id, f.feature, idf / top as w, g.page_id is not null as has from pr join f on f.page_id = pr.query_id join fw on fw.feature = f.feature cross join fm left join f g on g.page_id = pr.decl_id and g.feature = f.feature),
s as (select query_id, decl_id, sum(case when feature like 'app:%' then w else 0 end) as mass, sum(case when feature like 'app:%' and has then w else 0 end) as hit, sum(case when feature like 'rel:%' and not has then w else 0 end) as miss from x group by 1, 2)
select query_id, decl_id, round(coalesce(case when mass > 0 then greatest(0, (hit - 0.3 * case when exists (select 1 from f where f.page_id = s.decl_id and feature like 'rel:%') then miss else 0 end) / mass) end, 0), 6) as overlap from pr left join s using (query_id, decl_id)""")
def skeleton_overlap(spark, d):
    f = page_features(spark, d)
    weights = structure.feature_weights(f, table(spark, d, "pages").count())
    out = structure.skeleton_overlap(page_pairs(spark, d), f.withColumnRenamed("page_id", "query_id"), f.withColumnRenamed("page_id", "decl_id"), weights)
    return out.select("query_id", "decl_id", six("overlap").alias("overlap"))


@query(f"""with {LIB}, {PMI}, {ASKED}, {SCORED}, o as (select query_id, decl_id, score, rk, (decl_id * 31 + query_id) % 100 / 100.0 as overlap from ranked where rk <= {Reranking().depth}),
g as (select *, max(overlap) over (partition by query_id) as best, max(score) over (partition by query_id) as top from o),
h as (select query_id, decl_id, rk, score / top + case when best >= 0.45 then 0.9 else 0 end * overlap as final from g),
k as (select query_id, decl_id, final, row_number() over (partition by query_id order by round(final, 9) desc, rk) as rk from h)
select query_id, decl_id, round(final, 6) as final, rk from k where rk <= 5""")
def gated_rerank(spark, d):
    lex = lexicon_of(spark, d)
    top = store.settled(retrieve.ranked(retrieve.scores(store.settled(retrieve.query_weights(asked(spark, d), lex)), lex), Reranking().depth))
    overlaps = top.select("query_id", "decl_id", ((F.col("decl_id") * 31 + F.col("query_id")) % 100 / 100.0).alias("overlap"))
    return structure.rerank(top, overlaps).select("query_id", "decl_id", six("final").alias("final"), "rk")


FORMULAS = [(1, ["d[X;Y] \\leq \\bbH[X+Y]"]), (2, ["\\sum_{i} a_i = \\log(b)", "x \\in S"]), (3, []), (4, ["\\left( H[X, Y] \\right) + 1 < 2"])]
STATEMENTS = [(1, "theorem foo (h : d[X # Y] = 0) : d[X;Y] ≤ H[X + Y] := by simp"), (2, "def bar : Nat := 1"), (3, "theorem baz {α : Type} : ∑ i, f i = log b")]


@query()
def tree_features(spark, d):
    m = spark.createDataFrame(FORMULAS, "id int, math array<string>").select(F.lit("latex").alias("side"), "id", F.explode(formula.latex_tree_features("math")).alias("feature"))
    h = spark.createDataFrame(STATEMENTS, "id int, head string").select(F.lit("head").alias("side"), "id", F.explode(formula.head_tree_features("head")).alias("feature"))
    return m.union(h)


@query()
def pattern_features(spark, d):
    m = spark.createDataFrame(FORMULAS, "id int, math array<string>").select(F.lit("latex").alias("side"), "id", F.explode(formula.latex_pattern_features("math")).alias("feature"))
    h = spark.createDataFrame(STATEMENTS, "id int, head string").select(F.lit("head").alias("side"), "id", F.explode(formula.head_pattern_features("head")).alias("feature"))
    return m.union(h)


# --- sources

TEX = r"""\newtheorem{thm}{Theorem}
\section{First part} % a comment
\begin{thm}[A title]\label{thm:a} Let $a+b$ be \emph{given}. \lean{Foo.bar, Foo.baz}\leanok \uses{thm:b} See \cref{thm:c}. \end{thm}
\begin{proof} By \uses{thm:a} and 50\% luck \[ x = y \] \end{proof}
\begin{definition} Something \cite[p. 1]{knuth, lamport} new. \end{definition}
\begin{proof} Unclosed"""
LEAN = """namespace Foo
/-- The sum
of things. -/
@[to_additive bar_add] lemma bar_mul (a b : M) :
    a * b = b * a := by
  simp
section
-- a remark
theorem IsCompact.isClosed [T2Space X] {s : Set X} (hs : IsCompact s) : IsClosed s := sorry
end
instance : Foo Bar := ⟨⟩
end Foo
def g : Nat := 1
"""


@query()
def latex_blocks(spark, d):
    return latex.parse_sources(spark.createDataFrame([("a.tex", TEX)], "path string, content string"))


@query()
def lean_declarations(spark, d):
    return lean.scan_sources(spark.createDataFrame([("Foo.lean", "Top.Foo", LEAN)], "path string, module string, content string"))


TEX_SQL = r"concat('Let $', left(text, 12), '$ be \[ x = ', doc_id, ' \] \emph{given ', lang, '}. See \cref{thm:', doc_id, '} and ~\cite[p. 1]{k', doc_id, '}, \uses{a,b}\label{eq:', doc_id, '} $$ \sum_i x_', doc_id % 7, ' $$ ', right(text, 20))"
MATH_SQL = r"['\bbH[X_' || doc_id % 5 || '] \leq \log |S|', ['d[X;Y] = ', 'a + b < ', '\mathcal{Q}-'][doc_id % 3 + 1] || '\frac{1}{' || doc_id % 9 || '}', '\' || regexp_replace(coalesce(text, 'x'), '[^a-zA-Z]', '', 'g')[1:doc_id % 14 + 1] || ' \in S']"


def tex(spark: SparkSession, d: str) -> DataFrame:
    """Documents as LaTeX: id, text, and some formulas, math."""
    i, t = F.col("doc_id"), F.col("text")
    text = F.concat(F.lit("Let $"), F.left(t, F.lit(12)), F.lit("$ be \\[ x = "), i, F.lit(" \\] \\emph{given "), F.coalesce("lang", F.lit("")), F.lit("}. See \\cref{thm:"), i, F.lit("} and ~\\cite[p. 1]{k"), i, F.lit("}, \\uses{a,b}\\label{eq:"), i, F.lit("} $$ \\sum_i x_"), i % 7, F.lit(" $$ "), F.right(t, F.lit(20)))
    letters = F.substring(F.regexp_replace(F.coalesce(t, F.lit("x")), "[^a-zA-Z]", ""), F.lit(1), (i % 14 + 1).cast("int"))
    second = F.when(i % 3 == 0, "d[X;Y] = ").when(i % 3 == 1, "a + b < ").otherwise("\\mathcal{Q}-")
    math = F.array(F.concat(F.lit("\\bbH[X_"), i % 5, F.lit("] \\leq \\log |S|")), F.concat(second, F.lit("\\frac{1}{"), i % 9, F.lit("}")), F.concat(F.lit("\\"), letters, F.lit(" \\in S")))
    return table(spark, d, "documents").where("text is not null").select(i.alias("id"), text.alias("text"), math.alias("math"))


@query(f"with t as (select doc_id as id, {TEX_SQL} as text from documents where text is not null) select id, array_to_string({markup.formulas_sql('text')}, ';') as math, {markup.prose_sql('text')} as prose from t")
def math_extract_and_clean(spark, d):
    return tex(spark, d).select("id", F.array_join(markup.formulas(F.col("text")), ";").alias("math"), markup.prose(F.col("text")).alias("prose"))


@query(f"with t as (select doc_id as id, {MATH_SQL} as math from documents where text is not null) select id, array_to_string({formula.latex_skeleton_sql('math')}, ' ') as features from t")
def skeleton_features(spark, d):
    return tex(spark, d).select("id", F.array_join(formula.latex_skeleton_features("math"), " ").alias("features"))


@query(f"with t as (select doc_id as id, {MATH_SQL} as math from documents where text is not null) select id, array_to_string({markup.symbol_bag_sql('math')}, ' ') as symbols from t")
def symbol_bag(spark, d):
    return tex(spark, d).select("id", F.array_join(markup.symbol_bag(F.col("math")), " ").alias("symbols"))


TWIN_ROWS = [
    ("mul_comm", "theorem", "M.A", 1, "doc", "theorem mul_comm (a b : CommMonoid) : mul a b", "", "@[to_additive]", "source"),
    ("Submonoid.FG.prod", "theorem", "M.B", 2, "", "theorem prod", "Submonoid.FG", "@[simp, to_additive prod]", "source"),
    ("continuous_foo", "theorem", "M.B", 3, "", "", "", "@[to_additive]", "source"),
    ("Monoid.foo", "def", "M.C", 4, "", "def foo : Monoid", "Monoid", '@[to_additive "docs"]', "source"),
    ("one_x", "def", "M.C", 5, "", "", "", "@[to_additive]", "source"),
    ("zero_x", "def", "M.C", 6, "", "", "", "", "source"),
]
TRUTH = [("add_comm", "M.A"), ("mul_comm", "M.A"), ("other", "M.C")]


def twin_rows(spark: SparkSession) -> DataFrame:
    from ..schemas import DECLARATION

    return spark.createDataFrame(TWIN_ROWS, DECLARATION)


@query("select * from (values ('add_comm', 'to_additive:inferred:unvalidated', '', 'add comm comm add monoid add'), ('AddSubmonoid.FG.prod', 'to_additive:explicit:unvalidated', '', 'sum'), ('AddMonoid.foo', 'to_additive:inferred:unvalidated', '', 'foo add monoid')) t(name, provenance, head, typ)")
def additive_twins(spark, d):
    out, _ = twins.expand(twin_rows(spark))
    return out.where(F.startswith("provenance", F.lit("to_additive"))).select("name", "provenance", "head", F.array_join("typ_tokens", " ").alias("typ"))


@query("select * from (values ('inferred:validated', 1), ('explicit:unvalidated', 1), ('inferred:untranslatable', 1), ('inferred:dropped', 1)) t(outcome, n)")
def twin_validation(spark, d):
    _, counts = twins.expand(twin_rows(spark), spark.createDataFrame(TRUTH, "name string, module string"))
    return counts


@query("with r as (select doc_id as id, doc_id % 7 <> 0 as has_index, doc_id % 5 <> 0 as has_meta, case when doc_id % 11 = 0 then null else doc_id % 4 end as v, case when doc_id % 3 = 0 then null else doc_id % 10 end as t, doc_id % 6 as size from documents) select id, not has_index or not has_meta or coalesce(v, 1) <> 3 or (size > 0 and coalesce(t, 0) <> size) as stale from r")
def staleness_check(spark, d):
    i = F.col("doc_id")
    stale = store.is_stale(i % 7 != 0, i % 5 != 0, F.when(i % 11 != 0, i % 4), F.when(i % 3 != 0, i % 10), i % 6)
    return table(spark, d, "documents").select(i.alias("id"), stale.alias("stale"))


# --- graph


LINKS = "refs as (select page_id, url as src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as dst from pages), named as (select src, case when starts_with(dst, '/') then regexp_extract(src, '^(https?://[^/]+)', 1) || dst else dst end as dst from refs)"


def page_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"))
    return p.select("src", F.when(F.startswith("dst", F.lit("/")), F.concat(F.regexp_extract("src", "^(https?://[^/]+)", 1), "dst")).otherwise(F.col("dst")).alias("dst"))


@query(f"with {LINKS}, l as (select src, dst, case when length(dst) % 2 = 0 then 'uses' else 'ref' end as source from named union all select url, url, 'ref' from pages) select src, dst, max(source) as source, bool_or(dst in (select url from pages)) as resolved from l group by 1, 2")
def page_link_graph(spark, d):
    links = page_links(spark, d).withColumn("source", F.when(F.length("dst") % 2 == 0, "uses").otherwise("ref"))
    own = table(spark, d, "pages").select(F.col("url").alias("src"), F.col("url").alias("dst"), F.lit("ref").alias("source"))
    inside, outside = graph.resolve(graph.labelled_references(links.union(own)), table(spark, d, "pages").select(F.col("url").alias("id")))
    return inside.withColumn("resolved", F.lit(True)).union(outside.withColumn("resolved", F.lit(False)))


@query("with r as (select l_orderkey as src, l_partkey as dst, case when l_returnflag = 'A' then 'uses' else 'ref' end as source from lineitem) select src, dst, case when bool_or(source = 'uses') then 'uses' else 'ref' end as source from r group by 1, 2")
def edge_union_label(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "A", "uses").otherwise("ref").alias("source"))
    return graph.labelled_references(r)


def conversation_graph(spark: SparkSession, d: str) -> graph.Graph:
    """Turns as blocks: a reply proves the request before it, and depends on the turn before that."""
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "theorem").otherwise("proof")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    rows = c.select("conv_id", "turn", F.lit("env").alias("env"), kind.alias("kind"), F.lit("").alias("title"), F.lit("").alias("section"), F.col("turn").cast("int").alias("line"), F.coalesce("text", F.lit("")).alias("text"), name(F.col("turn")).alias("id"), F.array().cast("array<string>").alias("declared_lean"), F.lit(False).alias("lean_ok"), F.col("turn").cast("int").alias("ord"), F.array(name(F.col("turn") - 2)).alias("uses"), F.array().cast("array<string>").alias("refs"))
    filled = relational.carried(rows, ["conv_id"], ["turn"], F.col("kind") == "theorem", F.col("id"), "parent")
    return graph.build(filled.withColumn("proof_of", F.when(F.col("kind") == "proof", F.coalesce("parent", F.lit(""))).otherwise("")))


@query("""with c as (select *, conv_id || ':' || turn as id, role = 'user' as claim, conv_id || ':' || (turn - 2) as dst, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as parent from conversations)
select count(*) as nodes, count(*) filter (where claim) as claims, count(*) filter (where not claim) as proofs, 0::bigint as authored_lean_annotations,
count(*) filter (where not claim and parent is not null) + (select count(*) from (select distinct id, dst from c where dst in (select id from c))) as internal_edges, (select count(*) from (select distinct id, dst from c where dst not in (select id from c))) as dangling_refs, count(*) filter (where claim) as not_attempted from c""")
def graph_summary(spark, d):
    s = graph.summary(conversation_graph(spark, d))
    return s.select("nodes", "claims", "proofs", "authored_lean_annotations", "internal_edges", "dangling_refs", F.try_element_at("alignment_status", F.lit("not_attempted")).alias("not_attempted"))


@query("""with c as (select *, conv_id || ':' || turn as id, conv_id || ':' || (turn - 2) as dst from conversations)
select '  "' || id || '" [label="' || id[:44] || '", style="rounded,filled", fillcolor="#eeeeee"];' as line from c where role = 'user' union all select '  "' || id || '" -> "' || dst || '";' from (select distinct id, dst from c) where dst in (select id from c)""")
def dot_export(spark, d):
    return graph.dot_lines(conversation_graph(spark, d)).select("line")


# --- joins and orderings


@query("select a.event_id, a.user_id, c.event_id as click_id from (select * from events where event_type = 'purchase') a asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'click' group by 1, 2) c on a.user_id = c.user_id and a.ts >= c.ts")
def as_of_context(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return relational.as_of(left, right, "user_id", "ts", "click_id").select("event_id", "user_id", "click_id")


@query("select conv_id, turn, role, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as parent from conversations")
def forward_fill_parent(spark, d):
    c = table(spark, d, "conversations")
    return relational.carried(c, ["conv_id"], ["turn"], F.col("role") == "user", F.col("turn"), "parent").select("conv_id", "turn", "role", "parent")


@query("select conv_id, turn, min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following) as reply from conversations")
def next_match(spark, d):
    c = table(spark, d, "conversations")
    return relational.next_match(c, ["conv_id"], ["turn"], F.col("role") == "assistant", F.col("turn"), "reply").select("conv_id", "turn", "reply")


@query("select conv_id, turn, role || ':' || row_number() over (partition by conv_id order by turn) as id from conversations")
def block_ordinal(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("string")).alias("id"))


@query("select min(doc_id) as doc_id, lower(trim(text)) as body from documents group by 2")
def first_seen_dedupe(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lower(F.trim("text")).alias("body"))
    return relational.first_seen(rows, ["body"], "doc_id")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def semi_targets(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_targets(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("select a.doc_id as name, coalesce(nullif(case when a.doc_id % 3 = 0 then a.lang else '' end, ''), b.doc, '') as doc from documents a left join (select doc_id, 'q' || max(quality) as doc from labels group by 1) b using (doc_id)")
def left_merge_docs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("doc"))
    src = table(spark, d, "labels").select(F.col("doc_id").alias("name"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("doc"), F.col("quality").alias("line"))
    return lean.carry_docs(rows, src)


@query("select l_orderkey, count(*) as n, min(l_linenumber) as first from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate and l_shipdate < o_orderdate + interval 30 day group by 1")
def span_containment(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate")
    spans = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("b"))
    return relational.contained(points, spans, "k", "l_shipdate", "a", "b").groupBy(F.col("k").alias("l_orderkey")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"))


@query("with t as (select item_id, unnest([item_id * 11, item_id * 7, item_id * 3]) as doc_id, unnest([1, 2, 3]) as pos from benchmark) select item_id, arg_min(t.doc_id, pos) as doc_id from t join documents using (doc_id) group by 1")
def first_resolvable_target(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.array(F.col("item_id") * 11, F.col("item_id") * 7, F.col("item_id") * 3).alias("targets"))
    return relational.first_known(b, "item_id", "targets", table(spark, d, "documents").select("doc_id"), "doc_id")


@query("with t as (select item_id, [item_id * 11, item_id * 7, item_id * 3] as ids from benchmark), n as (select list(doc_id) as have from documents) select item_id, array_to_string(list_filter(ids, lambda i: list_contains(have, i)), ',') as known from t, n")
def known_targets(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.array(F.col("item_id") * 11, F.col("item_id") * 7, F.col("item_id") * 3).alias("ids"))
    text = b.withColumn("ids", F.transform("ids", lambda i: i.cast("string")))
    out = relational.keep_known(text, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name")), "ids")
    return out.select("item_id", F.array_join("ids", ",").alias("known"))


@query("select source, (dense_rank() over (order by source) - 1) % 2 as fold from (select distinct source from documents)")
def alternating_fold(spark, d):
    return relational.alternate(table(spark, d, "documents"), "source").withColumn("fold", F.col("fold").cast("long"))


@query(f"select doc_id as decl_id, {lexical.draw_sql("'holdout'", 'doc_id')} % 1000000 < 20000 as held from documents")
def hash_holdout(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("decl_id"))
    return rows.select("decl_id", lexicon.split(rows, 0.02, "holdout").alias("held"))


@query(f"with t as (select doc_id, coalesce(text, '') as text from documents) select doc_id, {vectors.shortened_sql('text', 'doc_id')} as text from t")
def word_drop_augment(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.shortened(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))


# --- vectors: every hundredth vector asks, all answer

COSINE = "cs as (select a.vec_id as query_id, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b where a.vec_id % 100 = 0 and b.vec_id <> a.vec_id), ck as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rk from cs)"


def nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.top_k(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k + 1).where("query_id <> id")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rk")
    return found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


@query(f"with {COSINE} select query_id, id, round(score, 6) as score, rk from ck where rk <= 10")
def cosine_topk(spark, d):
    return nearest(spark, d, 10).select("query_id", "id", six("score").alias("score"), "rk")


@query(f"with {COSINE}, r2 as (select query_id, id, row_number() over (partition by query_id order by id desc) as rk from ck where rk <= 20), u as (select query_id, id, rk from ck where rk <= 20 union all select query_id, id, rk from r2) select query_id, id, round(sum(1.0 / (60 + rk)), 6) as score from u group by 1, 2")
def rrf_fusion(spark, d):
    from pyspark.sql import Window

    a = nearest(spark, d, 20).select("query_id", "id", "rk")
    b = a.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id"))))
    return vectors.fuse([a, b]).select("query_id", "id", six("score").alias("score"))


_DENSE_ARM = "select f.query_id, '{}' as kind, round(d.score, 6) as coverage, round(coalesce((max(case when f.rk = 1 then f.score end) - avg(case when f.rk between 2 and 10 then f.score end)) / max(case when f.rk = 1 then f.score end), 1.0), 6) as margin, max(case when f.rk = 1 and a.label = b.label then 1 else 0 end) as rank from {} f join ck d on d.query_id = f.query_id and d.rk = 1 join embeddings a on a.vec_id = f.query_id join embeddings b on b.vec_id = f.id group by f.query_id, d.score"


@query(
    f"with {COSINE}, r2 as (select query_id, id, row_number() over (partition by query_id order by id) as rk from ck where rk <= 200), u as (select query_id, id, rk from ck where rk <= 200 union all select query_id, id, rk from r2), s as (select query_id, id, sum(1.0 / (60 + rk)) as score from u group by 1, 2), "
    f"fu as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rk from s), de as (select * from ck where rk <= 200) {_DENSE_ARM.format('dense', 'de')} union all {_DENSE_ARM.format('hybrid', 'fu')}"
)
def dense_arms(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    gold = queries.select("query_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id")
    others = lambda rows: rows.where("query_id <> id")
    lexical_ = nearest(spark, d, 200).select("query_id", "id").withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    out = arms.dense_arm(queries, corpus, gold, "dense", None, others=others).union(arms.dense_arm(queries, corpus, gold, "hybrid", lexical_, others=others))
    return out.select("query_id", "kind", six("coverage").alias("coverage"), six("margin").alias("margin"), "rank")


GOLD = "gold as (select a.vec_id as query_id, b.vec_id as id from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0)"


def gold_ranks(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    found = nearest(spark, d, k).select("query_id", "id", "rk")
    labels = e.select(F.col("vec_id").alias("id"), "label")
    asked_ = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    gold = found.join(labels, "id").join(asked_, "query_id").where("label = wanted").select("query_id", "id")
    return asked_.select("query_id").join(calibrate.gold_rank(found, gold), "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"))


@query(f"with {COSINE}, {GOLD}, r as (select a.vec_id as query_id, coalesce(min(ck.rk), 0) as rank from embeddings a left join (select ck.* from ck join gold using (query_id, id) where rk <= 5) ck on ck.query_id = a.vec_id where a.vec_id % 100 = 0 group by 1) select count(*) as n, round(avg(case when rank = 1 then 1 else 0 end), 6) as recall_1, round(avg(case when rank > 0 then 1 else 0 end), 6) as recall_5, round(avg(case when rank > 0 then 1.0 / rank else 0 end), 6) as mrr from r")
def recall_mrr(spark, d):
    return calibrate.rank_report(gold_ranks(spark, d, 5)).select("n", six("recall_1").alias("recall_1"), six("recall_5").alias("recall_5"), six("mrr").alias("mrr"))


@query(f"with {COSINE}, {GOLD}, r as (select a.vec_id as query_id, coalesce(min(ck.rk), 0) as rank from embeddings a left join (select ck.* from ck join gold using (query_id, id) where rk <= {Reranking().depth}) ck on ck.query_id = a.vec_id where a.vec_id % 100 = 0 group by 1) select count(*) as n, count(*) filter (where rank > 0) as reached, round(avg(case when rank > 0 then 1 else 0 end), 6) as reach_rate, quantile_cont(rank, 0.5) filter (where rank > 0) as median_rank from r")
def median_rank_pool(spark, d):
    return calibrate.pool_report(gold_ranks(spark, d, Reranking().depth)).select("n", "reached", six("reach_rate").alias("reach_rate"), "median_rank")


@query(f"""with {LIB}, t as (select doc_id as id, unnest({MATCH_SET}) as token from documents), c as (select id, token, count(*) as n from t group by 1, 2), x as (select id, token, (1 + ln(n)) * idf as w from c join idf using (token)),
y as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as weight from x), v as (select id, sum(weight * (length(token) % 3)) as a, sum(weight * (ascii(token) % 5)) as b, sum(weight) as c from y group by 1)
select id, round(a / nullif(sqrt(a * a + b * b + c * c), 0), 6) as a, round(b / nullif(sqrt(a * a + b * b + c * c), 0), 6) as b, round(c / nullif(sqrt(a * a + b * b + c * c), 0), 6) as c from v""")
def bag_encode(spark, d):
    docs = table(spark, d, "documents")
    lex = lexicon_of(spark, d)
    raw = docs.select(F.col("doc_id").alias("id"), F.explode(lexical.raw_prose_words(F.coalesce("text", F.lit("")))).alias("w"))
    tokens = raw.select("id", lexical.stem(F.col("w")).alias("token"))
    table_ = lex.idf.select("token", F.array((F.length("token") % 3).cast("double"), (F.ascii("token") % 5).cast("double"), F.lit(1.0)).alias("vector"))
    out = vectors.encode(vectors.bag_weights(tokens, lex.idf), table_)
    return out.select("id", *[six(F.col("vector")[i]).alias(n) for i, n in enumerate("abc")])


@query()
def encoder_train(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), lexical.prose_word_set(F.coalesce("text", F.lit(""))).alias("words"), F.array_compact(F.array("lang", "source")).alias("tokens"))
    docs = store.settled(docs)
    enc = vectors.train(docs, counted=vectors.frequencies(docs))
    return enc.document_table(spark).select("token", six("idf").alias("idf"), F.size("vector").alias("dim"))


# --- calibration

RECORDS = "r as (select case when quality = 1 then 'pos' else 'neg' end as kind, (doc_id * 7 % 1000) / 1000.0 as coverage, (doc_id * 13 % 997) / 997.0 as margin, doc_id % 3 as rank from labels)"


def records(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")  # noqa: E741
    return l.select(F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("kind"), (F.col("doc_id") * 7 % 1000 / 1000.0).alias("coverage"), (F.col("doc_id") * 13 % 997 / 997.0).alias("margin"), (F.col("doc_id") % 3).alias("rank"))


def _counts(grid: str) -> str:
    on = "coverage >= tau and margin >= delta"
    return f"g as ({grid}), k as (select tau, delta, count(*) filter (where {on} and kind = 'pos' and rank = 1) as ok, count(*) filter (where {on} and kind = 'pos' and rank <> 1) as wrong, count(*) filter (where {on} and kind = 'neg') as bad, count(*) filter (where kind = 'pos') as np, count(*) filter (where kind = 'neg') as nn from g, r group by 1, 2)"


_SHARES = "[" + ", ".join(str(0.02 + 0.96 * i / 39) for i in range(40)) + "]"
_DELTAS = "[" + ", ".join(map(str, calibrate.MARGINS)) + "]"


@query(f"with {RECORDS}, t as (select distinct unnest(quantile_cont(c, {_SHARES})) as tau from (select distinct round(coverage, 3)::double as c from r)), {_counts(f'select tau, delta from t, (select unnest({_DELTAS})::double as delta)')} select round(tau, 6) as tau, delta, round(ok / (ok + wrong + bad), 6) as precision, round((ok + wrong) / np, 6) as answer_rate, round(bad / nn, 6) as false_match_rate from k where ok + wrong > 0 and ok / (ok + wrong + bad) >= 0.3 order by (ok + wrong) / np desc, k.tau, k.delta limit 1")
def precision_sweep(spark, d):
    return calibrate.precision_sweep(records(spark, d), 0.3).select(six("tau").alias("tau"), "delta", *[six(c).alias(c) for c in ("precision", "answer_rate", "false_match_rate")])


@query(f"with {RECORDS}, t as (select distinct coverage as raw from r where kind = 'pos'), f as (select ceil(raw * 10000) / 10000 as tau, coalesce(ceil(max(margin) * 10000) / 10000, 0) as delta from t left join r on r.kind = 'neg' and r.coverage >= raw group by raw), {_counts('select distinct tau, delta from f')} select round(tau, 6)::double as tau, round(delta, 6)::double as delta, ok + wrong as answered, ok as correct, np as n_pos, nn as n_neg from k where bad = 0 order by ok + wrong desc, ok desc, k.tau, k.delta limit 1")
def zero_false_sweep(spark, d):
    return calibrate.zero_false_sweep(records(spark, d)).select(six("tau").alias("tau"), six("delta").alias("delta"), "answered", "correct", "n_pos", "n_neg")


@query(f"with {RECORDS}, s as (select kind, coverage, floor(round(margin * 10000, 6)) / 10000 as margin, rank from r), t as (select distinct round(coverage, 4) as tau from s), g as (select tau, m.margin as delta, count(*) filter (where s.kind = 'pos' and s.rank = 1) as ok, count(*) as n from t join (select distinct margin from s) m on true join s on s.coverage >= tau and s.margin >= m.margin group by 1, 2) select round(ok / n, 6) as precision, n as answered, ok as correct from g order by ok / n desc, n desc limit 1")
def combined_sweep(spark, d):
    return calibrate.combined_sweep(records(spark, d)).select(six("precision").alias("precision"), "answered", "correct")


_DENSE_SHARES = "[" + ", ".join(str(0.3 + (0.999 - 0.3) * i / 39) for i in range(40)) + "]"
_DENSE_DELTAS = "[" + ", ".join(map(str, calibrate.DENSE_MARGINS)) + "]"


@query(f"with {RECORDS}, t as (select distinct unnest(quantile_cont(coverage::double, {_DENSE_SHARES})) as tau from r), {_counts(f'select tau, delta from t, (select unnest({_DENSE_DELTAS})::double as delta)')} select round(ok / (ok + wrong + bad), 6) as precision, ok + wrong + bad as answered, round(ok / greatest(np, 1), 6) as recall, round(tau, 6) as tau, delta from k where ok + wrong + bad >= 5 order by ok / (ok + wrong + bad) desc, ok + wrong + bad desc, k.tau, k.delta limit 5")
def dense_sweep(spark, d):
    return calibrate.dense_sweep(records(spark, d)).select(six("precision").alias("precision"), "answered", six("recall").alias("recall"), six("tau").alias("tau"), "delta")


@query("""with t as (select doc_id as id, case when quality = 1 then 'present' else 'absent' end as arm, case when quality = 1 then [doc_id * 3 % 10, 1] else []::bigint[] end as gold from labels), p as (select doc_id as id, case when doc_id % 4 = 0 then null else doc_id % 10 end as prediction from labels where doc_id % 11 <> 0),
j as (select t.*, p.prediction, p.id is null as missing, arm = 'present' and p.prediction is not null and list_contains(gold, p.prediction) as ok from t left join p using (id)),
c as (select count(*) filter (where arm = 'present') as np, count(*) filter (where arm = 'absent') as na, count(*) filter (where ok) as tp, count(*) filter (where arm = 'present' and prediction is not null) as an, count(*) filter (where arm = 'absent' and prediction is not null) as bad, count(*) filter (where missing) as mi from j)
select np as n_present, na as n_absent, round(tp / (an + bad), 4) as precision, round(tp / greatest(np, 1), 4) as recall, round(an / greatest(np, 1), 4) as answer_rate_present, round(bad / greatest(na, 1), 4) as false_match_rate_absent, mi as missing_predictions from c""")
def abstention_scorer(spark, d):
    l = table(spark, d, "labels").dropDuplicates(["doc_id"])  # noqa: E741
    text = lambda c: c.cast("string")
    gold = F.when(F.col("quality") == 1, F.array(text(F.col("doc_id") * 3 % 10), F.lit("1"))).otherwise(F.array().cast("array<string>"))
    tasks = l.select("doc_id", F.when(F.col("quality") == 1, "present").otherwise("absent").alias("arm"), gold.alias("gold")).withColumnRenamed("doc_id", "id")
    preds = l.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, text(F.col("doc_id") % 10)).alias("prediction"))
    return calibrate.score_predictions(tasks, preds)
