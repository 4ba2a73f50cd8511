"""The dependency graph of a paper: nodes, resolved edges, dangling references, summary, Graphviz."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import CANDIDATES, align

CLAIMS = ("theorem", "definition")
# The colours and the lines of a Graphviz file.
FILLS = {"matched": "#cfe8d5", "ambiguous": "#fdf0c8", "unmatched": "#f6d7d7"}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame  #: id, kind, env, title, section, line, text, authored_lean, formalized, ord, status, coverage, margin, candidates
    edges: DataFrame  #: src, dst, type (proves, depends_on), source (uses, ref; null)
    dangling: DataFrame  #: src, dst


def labelled_references(refs: DataFrame) -> DataFrame:
    """(src, dst, source) from rows (src, dst, source): one row a pair, uses before ref."""
    return refs.groupBy("src", "dst").agg(F.when(F.bool_or(F.col("source") == "uses"), "uses").otherwise("ref").alias("source"))


def resolve(refs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (src, dst, ...) whose target is among ``ids`` (id), and the rest."""
    known = ids.select(F.col("id").alias("dst")).distinct()
    return refs.join(known, "dst", "left_semi").select(*refs.columns), refs.join(known, "dst", "left_anti").select(*refs.columns)


def build(blocks: DataFrame, lexicon=None, retrieval=None, top: int = 5) -> Graph:
    """The graph of the parsed blocks of one paper; claims of four or more words are aligned if a lexicon is given.

    Ids are a paper's own labels: give each paper a graph of its own, as two may use one label.
    """
    authored = {"declared_lean": "authored_lean", "lean_ok": "formalized"}
    nodes = blocks.select("id", "kind", "env", "title", "section", "line", "text", *[F.col(a).alias(b) for a, b in authored.items()], "ord")
    if lexicon is not None:
        from ..config import GRAPH

        claims = nodes.where(F.col("kind").isin(*CLAIMS) & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= 4))
        queries = claims.select(F.col("id").alias("query_id"), "text", "title").dropDuplicates(["query_id"])
        found = align(queries, lexicon, retrieval or GRAPH, top)
        nodes = nodes.join(found.withColumnRenamed("query_id", "id"), "id", "left")
    else:
        nodes = nodes.withColumns({"status": F.lit(None).cast("string"), "coverage": F.lit(None).cast("double"), "margin": F.lit(None).cast("double"), "candidates": F.lit(None).cast(CANDIDATES)})
    said = blocks.select(F.col("id").alias("src"), F.explode(F.concat(F.transform("uses", lambda u: F.struct(u.alias("dst"), F.lit("uses").alias("source"))), F.transform("refs", lambda u: F.struct(u.alias("dst"), F.lit("ref").alias("source"))))).alias("r")).select("src", "r.dst", "r.source")
    inside, outside = resolve(labelled_references(said), blocks)
    proves = blocks.where("proof_of <> ''").select(F.col("id").alias("src"), F.col("proof_of").alias("dst"), F.lit("proves").alias("type"), F.lit(None).cast("string").alias("source"))
    edges = proves.unionByName(inside.select("src", "dst", F.lit("depends_on").alias("type"), "source"))
    return Graph(nodes, edges, outside.select("src", "dst"))


def summary(g: Graph) -> DataFrame:
    """One row: nodes, claims, proofs, internal_edges, dangling_refs, authored_lean_annotations, alignment_status (of claims)."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind").isin(*CLAIMS)).alias("claims"), F.count_if(F.col("kind") == "proof").alias("proofs"), F.count_if(F.size("authored_lean") > 0).alias("authored_lean_annotations"))
    status = g.nodes.where(F.col("kind").isin(*CLAIMS)).groupBy(F.coalesce("status", F.lit("not_attempted")).alias("s")).agg(F.count("*").alias("n"))
    status = status.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("alignment_status"))
    e, d = g.edges.agg(F.count("*").alias("internal_edges")), g.dangling.agg(F.count("*").alias("dangling_refs"))
    return n.crossJoin(e).crossJoin(d).crossJoin(status)  # four single rows


def dot_lines(g: Graph, aligned: bool = False) -> DataFrame:
    """(part, key, line): the lines of a Graphviz file in the order of part and key; proofs are hidden."""
    shown = g.nodes.where("kind <> 'proof'")
    quoted = lambda c, n: F.left(F.replace(c, F.lit('"'), F.lit("'")), F.lit(n))
    fill = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FILLS.items() for x in kv]), F.col("status")), F.lit("#eeeeee"))
    label = quoted(F.coalesce(F.nullif("title", F.lit("")), "id"), 44)
    out = shown.select(F.lit(1).alias("part"), F.concat_ws("|", F.format_string("%09d", "ord"), "id").alias("key"), F.format_string('  "%s" [label="%s", style="rounded,filled", fillcolor="%s"];', "id", label, fill).alias("line"))
    out = out.union(g.edges.where("type <> 'proves'").select(F.lit(2), F.concat_ws("|", "src", "dst"), F.format_string('  "%s" -> "%s";', "src", "dst")))
    if aligned:
        best = shown.where("status = 'matched'").select("id", F.col("candidates")[0]["name"].alias("name"))
        out = out.union(best.select(F.lit(3), F.col("name"), F.format_string('  "lib::%s" [label="%s", shape=note, style=filled, fillcolor="#dde6f5"];', "name", F.left("name", F.lit(46)))).distinct())
        out = out.union(best.select(F.lit(4), F.col("id"), F.format_string('  "%s" -> "lib::%s" [style=dashed, color="#7a8ba8", label="aligns"];', "id", "name")))
    return out


def to_dot(g: Graph, aligned: bool = False) -> str:
    """A Graphviz file; a paper's graph is small, so its lines meet on the driver."""
    lines = [r["line"] for r in dot_lines(g, aligned).orderBy("part", "key").collect()]
    return "\n".join(["digraph paper {", "  rankdir=BT;", '  node [shape=box, style=rounded, fontname="Helvetica", fontsize=10];', *lines, "}"])


def to_json(g: Graph) -> DataFrame:
    """(kind, json): a row for each node, edge and dangling reference, and the summary."""
    parts = {"node": g.nodes.orderBy("ord"), "edge": g.edges, "dangling_ref": g.dangling, "summary": summary(g)}
    rows = [d.select(F.lit(k).alias("kind"), F.to_json(F.struct(*d.columns)).alias("json")) for k, d in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])
