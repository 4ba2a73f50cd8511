"""Tokenisers, stemmer, additive names, mark-up and formula features on fixed examples."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import additive, formula, lexical, markup


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


STEMS = {
    "continuous": "continuous", "analysis": "analysis", "series": "series", "topos": "topos", "gas": "gas", "set": "set", "map": "map", "le": "le",
    "bases": "basis", "matrices": "matrix", "indices": "index", "classes": "class", "boxes": "box", "mappings": "mapping", "compactness": "compact", "boundedly": "bounded",
    "applications": "applic", "measurability": "measurabile", "-Sets-": "set", "groups": "group",
}


def test_stems(spark):
    rows = spark.createDataFrame(list(STEMS.items()), "w string, s string")
    assert {r["w"]: r["g"] for r in rows.select("w", lexical.stem(F.col("w")).alias("g")).collect()} == STEMS
    import duckdb

    for w, s in STEMS.items():
        assert duckdb.sql(f"select {lexical.stem_sql('w')} from (select '{w.lower()}' as w)").fetchall() == [(s,)]


@pytest.mark.parametrize("name, words", [("MeasureTheory.integral_add", "measure theory integral add"), ("IsCompact.isClosed", "is compact is closed"), ("foo'.bar", "foo bar"), ("HTTPServer2Go", "http server2 go"), ("", ""), ("α_β", "")])
def test_identifiers(spark, name, words):
    assert " ".join(one(spark, name, lexical.identifier_words)) == words


def test_prose_and_heads(spark):
    assert one(spark, "The `code here` of $x^2$ compact sets", lexical.prose_words) == ["compact", "set"]
    assert one(spark, "the of and theorem", lexical.prose_words) == []
    head = "theorem isClosed [T2Space X] {s : Set X} (hs : IsCompact s) : IsClosed s := by simp"
    words = one(spark, head, lexical.head_words)
    assert {"t2", "space", "closed"} <= set(words) and not {"simp", "by", "theorem", "x", "s"} & set(words)
    assert one(spark, "def g : Nat := Foo.bar", lexical.head_words) == ["nat"]
    assert one(spark, "def g : {a := Foo.bar}", lambda c: lexical.head_words(c, True)) == ["foo", "bar"]


@pytest.mark.parametrize("name, new", [("mul_comm", "add_comm"), ("Monoid.foo", "AddMonoid.foo"), ("continuous_foo", None), ("order_of_mul", "add_order_of_add"), ("mul_indicator_one", "indicator_zero"), ("CommMonoid.one_mul", "AddCommMonoid.zero_add"), ("MulOneClass", "AddZeroClass")])
def test_additive_names(name, new):
    assert additive.rename(name) == new


@pytest.mark.parametrize("source, explicit, placed", [("Submonoid.FG.prod", "prod", "AddSubmonoid.FG.prod"), ("Submonoid.FG.prod", "_root_.sum", "sum"), ("Foo.bar_mul", "bar_add", "Foo.bar_add"), ("bar", "baz", "baz"), ("Baz._root_.Foo.bar.", "x", "Foo.x"), ("A.B.c", "D.e", "A.D.e")])
def test_explicit_names(spark, source, explicit, placed):
    row = spark.createDataFrame([(source, explicit), (None, explicit), (source, None)], "s string, e string")
    assert [r["n"] for r in row.select(additive.explicit_additive_name("s", "e").alias("n")).collect()] == [placed, None, None]


def test_attributes(spark):
    rows = [("@[to_additive]", True, None), ("@[simp, to_additive foo_add]", True, "foo_add"), ("@[simp]", False, None), ("@[to_additive existing]", True, None), ('@[to_additive (attr := simp) "doc"]', True, None), (None, False, None)]
    got = spark.createDataFrame(rows, "a string, has boolean, name string").select("a", "has", "name", additive.has_attribute(F.col("a")).alias("h"), additive.explicit_target(F.col("a")).alias("n")).collect()
    assert all(r["has"] == r["h"] and (r["name"] == r["n"] or not r["has"]) for r in got), got
    assert one(spark, ["mul", "one", "monoid", "x"], additive.additive_words, "array<string>") == ["add", "zero", "add", "monoid", "x"]


def test_markup(spark):
    assert one(spark, "a \\% b % c\nd % e", markup.without_comments) == "a \\% b \nd "
    assert one(spark, r"$$a$$ and \[ b \]", markup.formulas)[0] == "b"
    assert one(spark, r"\emph{word} \foo{x} ~y \ref{z}", markup.prose) == "word x y REF"
    assert one(spark, r"\cref{b, a}\ref{c}", lambda c: markup.names_in(c, markup.REFERENCE)) == ["a", "b", "c"]
    assert one(spark, ["\\bbH[X] \\leq \\log |S|", "x = 0"], markup.symbol_bag, "array<string>") == ["m:h", "m:le", "m:log", "m:apply", "m:eq"]


def test_formula_features():
    assert formula.latex_skeleton(["d[X;Y] \\leq \\bbH[X+Y]"]) == ["app:d", "app:h", "bi:le|d", "bi:le|h", "op:add", "rel:le"]
    assert formula.latex_patterns(["d[X;Y] \\leq \\bbH[X+Y]"]) == ["pat:le(d[v0,v1]|h[v0+v1])", "shape:d[v0,v1]", "shape:h[v0+v1]"]
    assert formula.latex_tree(["d[X;Y] \\leq \\bbH[X+Y]"]) == ["L:app:d", "R:app:h", "R:op:add", "app:d", "app:h", "in:h:add", "op:add", "root:le"]
    assert formula.latex_patterns(["d[X;Y]"]) == [] and formula.latex_tree([""]) == []
    assert formula.latex_tree(["\\left( a \\right)"]) == []  # \le isn't read out of \left
    head = "theorem x (h : d[X # Y] = 0) : d[X;Y] ≤ H[X + Y] := by simp"
    assert formula.statement(head).strip() == "d[X;Y] ≤ H[X + Y]" and formula.hypotheses(head) == [" d[X # Y] = 0"]
    assert "pat:eq(|d[v0,v1])" in formula.head_patterns(head) and "app:d" in formula.head_skeleton(head)
    assert formula.bare_symbol("mathbbH") == "h" and formula.bare_symbol("bb") == "bb"
