"""Scanners, stores, streaming and the whole job on files."""

from pyspark.sql import functions as F

from lexiloom import engine
from lexiloom.operators import graph
from lexiloom.plans.catalogue import LEAN, TEX
from lexiloom.sources import latex, lean, store
from lexiloom.streaming import index_stream


def test_lean_scan(spark):
    rows = lean.scan_sources(spark.createDataFrame([("a", "Top.Foo", LEAN)], "path string, module string, content string")).orderBy("ord").collect()
    assert [r["name"] for r in rows] == ["Foo.bar_mul", "Foo.IsCompact.isClosed", "g"]
    first = rows[0]
    assert (first["kind"], first["doc"], first["attrs"], first["namespace"], first["line"]) == ("theorem", "The sum of things.", "@[to_additive bar_add]", "Foo", 4)
    assert first["head"] == "lemma bar_mul (a b : M) : a * b = b * a := by" and rows[2]["namespace"] == ""
    bad = spark.createDataFrame([("b", "M", bytearray(b"\xff\xfe def x"))], "path string, module string, content binary")
    assert lean.scan_sources(bad).count() == 0


def test_latex_blocks_and_graph(spark):
    blocks = latex.parse_sources(spark.createDataFrame([("a", TEX), ("b", None)], "path string, content string"))
    a, b, c = blocks.orderBy("ord").collect()
    assert (a["id"], a["kind"], a["title"], a["section"], a["line"], a["lean_ok"]) == ("thm:a", "theorem", "A title", "First part", 3, True)
    assert (a["uses"], a["refs"], a["math"], a["declared_lean"]) == (["thm:b"], ["thm:c"], ["a+b"], ["Foo.bar", "Foo.baz"])
    assert (b["kind"], b["proof_of"], b["uses"], b["math"]) == ("proof", "thm:a", ["thm:a"], ["x = y"]) and "luck" in b["text"]
    assert (c["kind"], c["id"], c["cites"]) == ("definition", "definition:3", ["knuth", "lamport"])
    g = graph.build(blocks)
    assert {(e["src"], e["dst"], e["type"], e["source"]) for e in g.edges.collect()} == {("proof:2", "thm:a", "proves", None), ("proof:2", "thm:a", "depends_on", "uses")}
    assert {e["dst"] for e in g.dangling.collect()} == {"thm:b", "thm:c"}
    s = graph.summary(g).first()
    assert (s["nodes"], s["claims"], s["proofs"], s["internal_edges"], s["dangling_refs"], s["alignment_status"]) == (3, 2, 1, 2, 2, {"not_attempted": 2})
    assert graph.to_dot(g).count("label=") == 2 and graph.to_json(g).count() == 3 + 2 + 2 + 1
    known = spark.createDataFrame([("Foo.bar",)], "name string")
    from lexiloom.operators.relational import keep_known

    assert keep_known(latex.annotated(blocks, 3), known, "targets").first()["targets"] == ["Foo.bar"]


def test_dump_and_docs(spark):
    rows = [("A.b", "M", "def", "Nat →\n  Nat"), ("A.c", "M", "ctor", "x"), ("d", None, "odd", None)]
    d = lean.elaborated_rows(spark.createDataFrame(rows, "name string, module string, kind string, type string"))
    got = {r["name"]: r for r in d.collect()}
    assert set(got) == {"A.b", "d"} and got["A.b"]["head"] == "def b : Nat → Nat" and got["A.b"]["namespace"] == "A" and got["d"]["kind"] == "theorem"
    src = spark.createDataFrame([("A.b", "first", 1), ("A.b", "last", 2), ("d", "", 3)], "name string, doc string, line int")
    assert {r["name"]: r["doc"] for r in lean.carry_docs(d, src).collect()} == {"A.b": "last", "d": ""}
    noise = spark.createDataFrame([("a._x", True), ("a.match_1", True), ("a.eq_12", True), ("a.eq_x", False), ("a.proof", True), ("a.b", False)], "n string, y boolean")
    assert noise.where(lean.is_noise(F.col("n")) != F.col("y")).count() == 0


def test_whole_job(spark, tmp_path):
    root = tmp_path / "Top"
    root.mkdir()
    (root / "Foo.lean").write_text(LEAN)
    (root / "More.lean").write_text("/-- A compact subset of a Hausdorff space is closed -/\ntheorem compact_closed : d[X;Y] ≤ H[X + Y] := x\ntheorem other_thing : True := x\n")
    (root / "skip.txt").write_text("def no : Nat := 1")
    assert engine.scan(spark, str(root), str(tmp_path / "raw")) == 5
    lex = engine.build_index(spark, store.read_lines(spark, str(tmp_path / "raw"), "declarations"), str(tmp_path / "index"))
    assert {r["name"] for r in lex.rows.collect()} >= {"Foo.bar_add", "Foo.bar_mul", "compact_closed"}
    assert not store.needs_build(spark, str(tmp_path / "index")) and store.needs_build(spark, str(tmp_path / "index"), 7) and store.needs_build(spark, str(tmp_path / "none"))
    asked = [(1, "every compact set is closed", "", ["d[A;B] \\leq H[A+B]"], "compact_closed"), (2, "", None, [], "nothing.here"), (3, "unrelated zebra", "", [], "other_thing")]
    q = spark.createDataFrame(asked, "query_id long, text string, title string, math array<string>, proposal string")
    for how in ("none", "struct", "tree"):
        best = engine.query(q, lex, how).where("query_id = 1 and rk = 1").first()
        assert best["name"] == "compact_closed"
    verdicts = {r["query_id"]: r for r in engine.verify(q, lex).collect()}
    assert (verdicts[1]["status"], verdicts[2]["status"], verdicts[3]["status"]) == ("verified", "nonexistent", "rejected")
    report = engine.measure(q, spark.createDataFrame([(1, "compact_closed")], "query_id long, name string"), lex, "none").first()
    assert (report["n"], report["recall_1"], report["mrr"]) == (1, 1.0, 1.0)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"name": "Foo.bar_mul", "kind": "def", "module": "Top.Foo", "line": 1, "provenance": "source"}\n')
    index_stream.append_words(index_stream.declarations(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["tokens"] == ["foo", "bar", "mul"]
