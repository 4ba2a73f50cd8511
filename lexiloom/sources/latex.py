"""Theorem-like blocks from LaTeX sources.

Which environments stand where, and which section and proof belong to which block, is a
scan of one file in order; everything a block says is worked out from its body by the
column expressions of :mod:`lexiloom.functions.markup`.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup as M

# Environments that hold statements.
STATEMENTS = """
theorem thm lemma lem proposition prop corollary cor definition defn def conjecture conj claim
fact remark rem example ex observation obs assumption hypothesis axiom notation question problem
""".split()

_NEW = re.compile(r"\\newtheorem\*?\{(?P<env>[^}]+)\}(?:\[[^\]]*\])?\{(?P<title>[^}]+)\}")
_SECTION = re.compile(M.SECTION)


def _title(body: str) -> tuple[str, str]:
    """The optional argument at a body's start, by bracket depth, and what follows it."""
    inner = body.lstrip()
    if not inner.startswith("["):
        return "", body
    depth = 0
    for k, c in enumerate(inner):
        depth += (c == "[") - (c == "]")
        if depth == 0:
            break
    return inner[1:k], inner[k + 1 :]


def block_places(source: str) -> list[tuple]:
    """(ord, env, kind, title, body, section, line) of each block of a source without comments.

    A block ends at the first end of its own environment; one that never ends is left out.
    Blocks inside other blocks count too.
    """
    declared = {m["env"].strip(): m["title"].strip().lower() for m in _NEW.finditer(source)}
    known = sorted({*declared, *STATEMENTS, "proof"}, key=len, reverse=True)
    sections = [(m.start(), m[1]) for m in _SECTION.finditer(source)]
    starts = [p for p, _ in sections]
    breaks = [m.start() for m in re.finditer("\n", source)]
    out = []
    for m in re.finditer(r"\\begin\{(" + "|".join(map(re.escape, known)) + r")\*?\}", source):
        env = m[1]
        end = re.compile(r"\\end\{" + re.escape(env) + r"\*?\}").search(source, m.end())
        if end is None:
            continue
        title, body = _title(source[m.end() : end.start()])
        defines = env.lower().startswith(("def", "notation")) or declared.get(env, "").startswith(("definition", "notation"))
        kind = "proof" if env == "proof" else "definition" if defines else "theorem"
        k = bisect_right(starts, m.start())
        out.append((len(out) + 1, env, kind, title, body, sections[k - 1][1] if k else "", 1 + bisect_right(breaks, m.start() - 1)))
    return out


def parse_sources(files: DataFrame) -> DataFrame:
    """Blocks of sources (path, content): one row a block, in the columns of ``schemas.BLOCK``.

    Ids are unique within a file only: a block's first label, else its environment and
    number. A proof belongs to the last statement before it in its file.
    """

    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["path"], b["content"]) for r in block_places(c or "")]
            yield pd.DataFrame(rows, columns=["path", "ord", "env", "kind", "title", "body", "section", "line"])

    bare = files.select("path", M.without_comments(F.col("content")).alias("content"))
    found = bare.mapInPandas(run, "path string, ord int, env string, kind string, title string, body string, section string, line int")
    body = F.col("body")
    label = F.regexp_extract(body, M.LABEL, 1)
    named = found.withColumn("label", label).withColumn("id", F.when(label != "", label).otherwise(F.concat_ws(":", "env", "ord")))
    earlier = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    proves = F.last(F.when(F.col("kind") != "proof", F.col("id")), ignorenulls=True).over(earlier)
    return named.select(
        "path", "ord", "id", "env", "kind", M.prose(F.col("title")).alias("title"), "label", M.prose(body).alias("text"), M.prose(F.col("section")).alias("section"), "line",
        F.when(F.col("kind") == "proof", F.coalesce(proves, F.lit(""))).otherwise("").alias("proof_of"),
        M.names_in(body, M.REFERENCE).alias("refs"), M.names_in(body, M.CITATION).alias("cites"), M.formulas(body).alias("math"),
        M.names_in(body, M.USES).alias("uses"), M.names_in(body, M.DECLARED).alias("declared_lean"), body.rlike(M.CHECKED).alias("lean_ok"),
    )


def read_sources(spark: SparkSession, paths: list[str] | str, suffix: str = "*.tex") -> DataFrame:
    """(path, content) of LaTeX files, undecodable bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(paths)
    return files.select("path", F.col("content").cast("string").alias("content"))


def read_paper(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Blocks of a paper's files with file_ord, a file's place in ``paths``."""
    order = F.create_map(*[x for k, p in enumerate(paths) for x in (F.lit(p.split(":", 1)[-1].rstrip("/")), F.lit(k))])
    blocks = parse_sources(read_sources(spark, paths))
    return blocks.withColumn("file_ord", F.try_element_at(order, F.regexp_replace("path", "^file:(//)?", "")))


def annotated(blocks: DataFrame, least_words: int = 5) -> DataFrame:
    """Statements with an authored annotation and enough words, as pairs (path, ord, id, text, title, targets, math)."""
    said = F.trim(F.when(F.col("title") != "", F.concat("title", F.lit(". "), "text")).otherwise(F.col("text")))
    kept = blocks.where((F.size("declared_lean") > 0) & (F.col("kind") != "proof"))
    return kept.where(F.size(F.filter(F.split(said, r"\s+"), lambda w: w != "")) >= least_words).select("path", "ord", "id", "text", "title", F.col("declared_lean").alias("targets"), "math")


def harvest(spark: SparkSession, root: str, known: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """Annotated statements of all LaTeX files under ``root`` that use the annotation macro; targets restricted to ``known`` names."""
    from ..operators.relational import keep_known

    files = read_sources(spark, root).where(F.contains("content", F.lit(r"\lean{"))).where(~F.col("path").rlike(r"/(\.lake|build|\.git|lake-packages|node_modules)/"))
    pairs = annotated(parse_sources(files)).withColumn("project", F.lit(project or root.rstrip("/").rsplit("/", 1)[-1]))
    return pairs if known is None else keep_known(pairs, known, "targets").where(F.size("targets") > 0)
