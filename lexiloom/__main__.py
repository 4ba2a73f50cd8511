"""Command line: scan, index, elaborate, query, verify, graph, setup, bench, verify-bench."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import engine
from .operators.graph import to_dot, to_json
from .sources import store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiloom")
    sub = p.add_subparsers(dest="job", required=True)
    for name, args in (("scan", ["source", "out"]), ("index", ["declarations", "out"]), ("setup", ["folder"]), ("query", ["index", "text"]), ("verify", ["index", "text", "proposal"]), ("graph", ["tex"]), ("elaborate", ["dump", "source", "out"]), ("bench", ["index", "tex"]), ("verify-bench", ["index", "tex"])):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a, nargs="+" if a == "tex" else None)
        if name in ("query", "verify"):
            s.add_argument("--title", default="")
            s.add_argument("--math", action="append", default=[])
        if name == "index":
            s.add_argument("--holdout", type=float, default=0.0)
            s.add_argument("--pmi-holdout", type=float, default=0.0)
        if name == "setup":
            s.add_argument("--source", action="append", default=[], metavar="NAME=ROOT")
        if name == "query":
            s.add_argument("--topk", type=int, default=5)
            s.add_argument("--rerank", choices=["none", "struct", "tree"], default="struct")
        if name == "verify":
            s.add_argument("--profile", choices=["precise", "balanced", "permissive"], default="permissive")
        if name == "graph":
            s.add_argument("--dot", action="store_true")
            s.add_argument("--json", metavar="FOLDER", help="write nodes, edges and the rest there as JSON lines")
            s.add_argument("--no-align", action="store_true")
            s.add_argument("--index", "--corpus", dest="index")
        if name == "verify-bench":
            s.add_argument("--seed", type=int, default=0)
            s.add_argument("--patterns", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    say = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2))
    if a.job == "scan":
        say({"declarations": engine.scan(spark, a.source, a.out)})
    elif a.job == "index":
        engine.build_index(spark, store.read_lines(spark, a.declarations, "declarations"), a.out, holdout=a.holdout, unlearned=a.pmi_holdout)
        say(spark.read.json(f"{a.out}/meta").first().asDict(recursive=True))
    elif a.job == "setup":
        say(engine.setup(spark, dict(s.split("=", 1) for s in a.source), a.folder))
    elif a.job == "elaborate":
        engine.elaborate(spark, a.dump, a.source, a.out)
        say(spark.read.json(f"{a.out}/meta").first().asDict(recursive=True))
    elif a.job == "graph":
        aligned = bool(a.index) and not a.no_align
        g = engine.draw(spark, a.tex, store.load(spark, a.index) if aligned else None)
        if a.json:
            to_json(g).write.mode("overwrite").partitionBy("kind").text(a.json)
        if a.dot or not a.json:
            print(to_dot(g, aligned) if a.dot else "\n".join(r["json"] for r in to_json(g).collect()))
    elif a.job in ("bench", "verify-bench"):
        said, lex = engine.annotated(spark, a.tex), store.load(spark, a.index)
        rows = engine.bench(said, lex) if a.job == "bench" else engine.verify_bench(said, lex, a.seed, a.patterns)
        say([r.asDict(recursive=True) for r in rows.collect()])
    else:
        asked = spark.createDataFrame([(0, a.text, a.title, a.math, getattr(a, "proposal", ""))], "query_id long, text string, title string, math array<string>, proposal string")
        lex = store.load(spark, a.index)
        out = engine.query(asked, lex, a.rerank, a.topk).orderBy("rk") if a.job == "query" else engine.verify(asked, lex, a.profile)
        rows = [r.asDict(recursive=True) for r in out.collect()]
        say(rows)
        return 0 if a.job == "query" or rows[0]["status"] == "verified" else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
