"""Declarations from trees of Lean source, and from dumps of an elaborated environment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DECLARATION, DUMP

# The grammar of a declaration's first line.
KINDS = ("theorem", "lemma", "def", "abbrev", "instance", "structure", "class", "inductive", "opaque", "axiom", "alias")
MODIFIERS = ("private", "protected", "noncomputable", "nonrec", "partial", "unsafe", "scoped", "local")
IDENTIFIER = r"[A-Za-z_α-ωΑ-Ω][A-Za-z0-9_'!?₀-₉α-ωΑ-Ω\.]*"
HEAD_LINES, HEAD_CHARACTERS = 3, 400

_PREFIX = rf"^(?:(?:{'|'.join(MODIFIERS)})\s+)*"
_LINE = re.compile(
    rf"(?P<doc>^\s*/--)|(?P<attribute>^\s*@\[)|(?P<open>^namespace\s+(?P<space>{IDENTIFIER})|^section(?:\s+{IDENTIFIER})?\s*$)|(?P<close>^end(?:\s+{IDENTIFIER})?\s*$)"
    rf"|(?P<nameless>{_PREFIX}instance\b\s*[:{{])|(?P<declared>{_PREFIX}(?P<kind>{'|'.join(KINDS)})\s+(?P<name>{IDENTIFIER}))"
)
_HEAD_STOPS = ("theorem", "lemma", "def", "/--")


def clean_doc(raw: str) -> str:
    """A docstring without its delimiters, its non-empty lines trimmed and joined."""
    body = raw.strip().removeprefix("/--").removesuffix("-/")
    return " ".join(filter(None, map(str.strip, body.splitlines())))


@dataclass
class Scanner:
    """Reads one file's lines in order; what waits for the next declaration is ``doc`` and ``attributes``."""

    module: str
    lines: list[str]
    spaces: list[str] = field(default_factory=list)
    doc: str = ""
    attributes: list[str] = field(default_factory=list)

    def forget(self) -> None:
        self.doc, self.attributes = "", []

    def until(self, start: int, mark: str, first: str) -> int:
        """The first line from ``start`` on that holds ``mark``, where ``first`` is what counts of the line ``start``."""
        if mark in first:
            return start
        return next((k for k in range(start + 1, len(self.lines)) if mark in self.lines[k]), len(self.lines) - 1)

    def __iter__(self) -> Iterator[tuple]:
        at = 0
        while at < len(self.lines):
            line = self.lines[at]
            m = _LINE.match(line)
            what = next((g for g in ("doc", "attribute", "open", "close", "nameless", "declared") if m and m[g] is not None), None)
            if what == "doc":
                end = self.until(at, "-/", line[m.end() :])
                self.doc = clean_doc("\n".join(self.lines[at : end + 1]))
                at = end
            elif what == "attribute":
                end = self.until(at, "]", line)
                head, bracket, rest = self.lines[end].partition("]") if "]" in self.lines[end] else (self.lines[end], "", "")
                self.attributes.append(" ".join(x.strip() for x in [*self.lines[at:end], head + bracket]))
                if rest.strip():
                    self.lines[end] = rest.strip()  # what stands behind the bracket is a line of its own
                    at = end
                    continue
                at = end
            elif what == "open":
                self.spaces.append(m["space"] or "")
                self.forget()
            elif what == "close":
                del self.spaces[-1:]
                self.forget()
            elif what == "nameless":
                self.forget()
            elif what == "declared":
                space = ".".join(filter(None, self.spaces))
                name = f"{space}.{m['name']}" if space else m["name"]
                yield name, "theorem" if m["kind"] == "lemma" else m["kind"], self.module, at + 1, self.doc, self.head(at), space, " ".join(self.attributes), "source"
                self.forget()
            elif line.strip() and not line.strip().startswith("--"):
                self.doc = ""
            at += 1

    def head(self, at: int) -> str:
        taken = [self.lines[at]]
        for line in self.lines[at + 1 : at + HEAD_LINES]:
            if ":=" in taken[-1] or "where" in taken[-1] or line.strip().startswith(_HEAD_STOPS):
                break
            taken.append(line)
        return " ".join(map(str.strip, taken))[:HEAD_CHARACTERS]


def scan_sources(files: DataFrame) -> DataFrame:
    """Declarations of files (path, module, content, binary or text), with path and ord, their place within a file.

    A file is one row, so a task holds one file at a time. One that isn't UTF-8 has none.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, module, content in zip(b["path"], b["module"], b["content"]):
                try:
                    text = content.decode("utf-8") if isinstance(content, bytes) else content or ""
                except UnicodeDecodeError:
                    continue
                lines = [x.rstrip("\r") for x in text.split("\n")]
                rows += [(path, k, *d) for k, d in enumerate(Scanner(module, lines))]
            yield pd.DataFrame(rows, columns=["path", "ord", *[c.split()[0] for c in DECLARATION.split(", ")]])

    return files.select("path", "module", "content").mapInPandas(run, f"path string, ord int, {DECLARATION}")


def scan_tree(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Declarations of all ``.lean`` files under ``root``, whose own name begins every module; ordered by path and place if limited."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.lean").load(root)
    top = root.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_replace(F.split_part("path", F.lit(f"/{top}/"), F.lit(-1)), r"\.lean$", "")
    named = files.select("path", F.concat(F.lit(f"{top}."), F.replace(inside, F.lit("/"), F.lit("."))).alias("module"), "content")
    out = scan_sources(named)
    return out.orderBy("path", "ord").limit(limit) if limit else out


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Declarations of an elaborated dump in JSON lines, malformed lines left out; constructors, recursors and quotients too."""
    d = spark.read.schema(DUMP).option("mode", "DROPMALFORMED").json(path)
    return elaborated_rows(d)


def elaborated_rows(dump: DataFrame) -> DataFrame:
    """Dump rows (name, module, kind, type) in the shape of scanned declarations."""
    known = F.col("kind").isin("theorem", "def", "axiom", "inductive", "opaque", "ctor", "rec", "quot")
    parts = F.split("name", r"\.")
    d = dump.where("name is not null").withColumn("kind", F.when(known, F.col("kind")).otherwise("theorem")).where("kind not in ('ctor', 'rec', 'quot')")
    typed = F.trim(F.regexp_replace(F.coalesce("type", F.lit("")), r"\s+", " "))
    return d.select(
        "name", "kind", F.coalesce("module", F.lit("")).alias("module"), F.lit(0).alias("line"), F.lit("").alias("doc"),
        F.concat("kind", F.lit(" "), F.element_at(parts, -1), F.lit(" : "), typed).alias("head"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".").alias("namespace"), F.lit("").alias("attrs"), F.lit("elaborated").alias("provenance"),
    )


def is_noise(name: Column) -> Column:
    """Whether a constant of an environment was made by the compiler, by its name's parts."""
    part = r"_.*|proof|eq_def|match_.*|eq_[0-9]+"
    return (name == "") | name.startswith("_example") | name.rlike(rf"(^|\.)({part})(\.|$)")


def carry_docs(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` whose empty doc is filled from the scanned declaration of their name; of several, the last by (path, ord)."""
    order = [c for c in ("path", "ord", "module", "line") if c in sources.columns]
    docs = sources.where("doc <> ''").groupBy("name").agg(F.max_by("doc", F.struct(*order)).alias("_doc"))
    filled = rows.join(docs, "name", "left").withColumn("doc", F.coalesce(F.nullif("doc", F.lit("")), "_doc", F.lit("")))
    return filled.select(*rows.columns)
