"""Every query with SQL against DuckDB on the smallest tables; invariants of scores and sweeps."""

import math
import os
import random
import re
from collections import Counter
from functools import partial

import duckdb
import numpy as np
import pytest

from lexiloom.operators import arms, audit, calibrate, lexicon, retrieve, vectors
from lexiloom.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no driver tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = sql.sql(catalogue.ORACLES[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, D).count() > 0


def test_coverage_is_a_share_and_empty_queries_stay(spark):
    lex = catalogue.lexicon_of(spark, D)
    q = catalogue.asked(spark, D).unionByName(spark.createDataFrame([(-1, "", None)], "query_id long, text string, title string"))
    rows = retrieve.align(q, lex).collect()
    assert all(-1e-9 <= r["coverage"] <= 1 + 1e-9 and r["margin"] <= 1 + 1e-9 for r in rows)
    assert [r["status"] for r in rows if r["query_id"] == -1] == ["unmatched"]


def test_corruption_never_gives_the_gold(spark):
    lib = spark.createDataFrame([("A.x", "m"), ("B.x", "m"), ("A.y", "n"), ("C.z", "m"), ("solo", "k")], "name string, module string")
    gold = spark.createDataFrame([(1, "A.x"), (2, "A.y"), (3, "solo")], "query_id long, name string")
    rows = audit.corrupted(gold, lib).collect()
    of = {1: "A.x", 2: "A.y", 3: "solo"}
    assert all((r["proposal"] == of[r["query_id"]]) == (r["population"] == "correct") for r in rows)
    assert {r["proposal"] for r in rows if r["population"] == "wrong_namespace"} == {"B.x"}
    assert {r["proposal"] for r in rows if r["population"] == "sibling" and r["query_id"] == 1} <= {"B.x", "C.z"}
    assert not {r["proposal"] for r in rows if r["population"] == "hallucinated"} & {"A.x", "B.x", "A.y", "C.z", "solo"}


def test_retrieval_in_blocks_equals_all_scores(spark):
    rng = random.Random(5)
    drawn = lambda n: [f"t{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randrange(n))]
    rows = [(i, f"n{i}", drawn(6), drawn(3), drawn(2)) for i in range(120)] + [(7, "n7", ["t1", "t2"], None, ["t9"]), (200, "e", None, ["t1"], []), (None, "x", ["t1"], [], [])]
    rows += [(300 + i, "c", ["t1", "t4"], [], []) for i in range(20)]
    lib = spark.createDataFrame(rows, "decl_id long, name string, tokens array<string>, mod_tokens array<string>, typ_tokens array<string>").repartition(3)
    df = lexicon.document_frequency(lib, "tokens", "mod_tokens", "typ_tokens")
    posted = lexicon.postings(lib)
    idf = lexicon.inverse_frequency(df, lib).join(lexicon.posting_sizes(posted), "token", "left").fillna(0, ["n_name", "n_mod", "n_typ"])
    lex = lexicon.Lexicon(lib, idf, posted, lexicon.length_norms(lib, idf), spark.createDataFrame([], "word string, token string, weight double, rk int"))
    asked = [(f"q{i}", t, 1.0 + i % 3) for i in range(25) for t in {f"t{rng.randrange(14)}" for _ in range(4)}] + [(None, "t1", 1.0), ("none", "zz", 1.0)]
    weights = spark.createDataFrame(asked, "query_id string, token string, weight double")
    of = lambda d: sorted((r["query_id"], r["rk"], r["decl_id"], round(r["score"], 9), round(r["raw"] / r["mass"], 9)) for r in d.collect())
    for depth in (3, 500):
        expected = of(retrieve.ranked(retrieve.scores(weights, lex), depth))
        for block, most in ((4096, 10**6), (16, 30)):
            assert of(retrieve.best(weights, lex, depth, block=block, most=most)) == expected
    assert not retrieve.best(weights.where("false"), lex, 3).count()
    same = spark.createDataFrame([(1, "n1", "t1 alpha"), (2, "n2", "t4")], "query_id long, name string, text string")
    got = arms.docstring_arms(same, same.where("query_id = 1"), lex)
    assert sorted((r["query_id"], r["kind"]) for r in got.collect()) == [(1, "neg"), (1, "pos"), (2, "pos")]
    # no row for each word that a query and a declaration share
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, decl_id", got._jdf.queryExecution().executedPlan().toString())


def test_zero_false_sweep_equals_brute_force(spark):
    rng = random.Random(3)
    schema = "kind string, coverage double, margin double, rank int"
    cases = [[("pos", 0.9, 0.5, 1), ("pos", 0.8, 0.6, 2), ("pos", 0.3, 0.9, 1), ("neg", 0.85, 0.40001, 0), ("neg", 0.2, 0.99, 0)]]
    cases.append([(rng.choice(["pos", "neg"]), rng.choice([rng.random(), rng.randrange(11) / 10]), rng.choice([rng.random(), rng.randrange(11) / 10]), rng.randrange(3)) for _ in range(60)])
    up = lambda x: math.ceil(x * 10_000) / 10_000
    for rows in cases:
        neg = [(c, m) for k, c, m, _ in rows if k == "neg"]
        cuts = {(up(raw), up(max((m for c, m in neg if c >= raw), default=0.0))) for k, raw, _, _ in rows if k == "pos"}
        found = []
        for tau, delta in cuts:
            ranks = [r for k, c, m, r in rows if k == "pos" and c >= tau and m >= delta]
            if not any(c >= tau and m >= delta for c, m in neg):
                found.append((-len(ranks), -ranks.count(1), tau, delta))
        best = calibrate.zero_false_sweep(spark.createDataFrame(rows, schema)).first()
        assert (-best["answered"], -best["correct"], best["tau"], best["delta"]) == min(found)
    assert calibrate.zero_false_sweep(spark.createDataFrame([], schema)).count() == 0


def test_threshold_searches_pair_nothing(spark):
    plans = [f(catalogue.records(spark, D)) for f in (calibrate.combined_sweep, calibrate.zero_false_sweep, calibrate.precision_sweep)] + [calibrate.dominating(catalogue.verifier_records(spark, D), 0.5, 0.5)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|Cartesian|SinglePartition", plan), plan


def test_nearest_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.standard_normal((300, 4)), 1)
    v[5], v[6], v[250:] = 0, v[7], v[:50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = corpus.where("id % 9 = 0 or id = 5").withColumnRenamed("id", "query_id")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    expected = set()
    for q in [*range(0, 300, 9), 5]:
        if v[q].any():
            s = np.round(unit @ unit[q], 9)
            best = sorted((i for i in range(300) if v[i].any()), key=lambda i: (-s[i], i))[:7]
            expected |= {(q, i, k) for k, i in enumerate(best, 1)}
    for numbers in (10**6, 40):
        assert {(r["query_id"], r["id"], r["rk"]) for r in vectors.top_k(asked, corpus, 7, numbers).collect()} == expected


def test_encoder_counts_every_document(spark, tmp_path):
    rows = [(i, f"alpha beta w{i % 40}", ("en", "de", None)[i % 3], f"s{i % 7}") for i in range(2300)] + [(2300 + i, "alpha gamma", "once", f"rare{i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = Counter(t for _, _, lang, source in rows for t in {lang, source} - {None})
    got = catalogue.QUERIES["encoder_train"](spark, str(tmp_path)).collect()
    assert {r["token"]: r["idf"] for r in got} == pytest.approx({t: math.log(1 + len(rows) / (1 + n)) for t, n in df.items()}, abs=2e-6)
    assert {r["dim"] for r in got} == {128}


def test_encoder_learns_from_every_document(spark, tmp_path, monkeypatch):
    n, chosen, bags = 196 * 1024, set(), vectors._Numbered.bags
    spark.range(n).selectExpr("id as doc_id", "concat('alpha w', id % 40) as text", "'en' as lang", "concat('s', id % 7) as source").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(vectors, "train", partial(vectors.train, dim=2, epochs=1, batch=1024))
    monkeypatch.setattr(vectors._Numbered, "bags", lambda self, rows, idf: chosen.update(rows.tolist()) or bags(self, rows, idf))
    catalogue.QUERIES["encoder_train"](spark, str(tmp_path))
    assert chosen == set(range(n))


def test_bags_of_a_batch_equal_a_dense_matrix():
    rng = np.random.default_rng(5)
    held = rng.random((20, 700)) < rng.random(700) ** 4
    held[3] = False
    assert {1, 2, vectors.FEW, vectors.FEW + 1} <= set(held.sum(0).tolist())
    r, c = np.nonzero(held)
    for kept in (np.ones(len(r), bool), held.sum(0)[c] == 1, held.sum(0)[c] > vectors.FEW, r < 0):
        w = rng.random(kept.sum()).astype(np.float32)
        full, rows, inner = np.zeros((20, 700), np.float32), rng.standard_normal((700, 6)).astype(np.float32), rng.standard_normal((20, 6)).astype(np.float32)
        full[r[kept], c[kept]] = w
        bag = vectors._Bags(r[kept], c[kept], w, 20)
        assert np.array_equal(np.sort(bag.u), np.unique(c[kept]))
        assert bag.times(rows[bag.u]) == pytest.approx(full @ rows, abs=1e-4)
        assert bag.back(inner) == pytest.approx((full.T @ inner)[bag.u], abs=1e-4)


def test_training_of_numbered_pairs_equals_dense_steps(spark, tmp_path):
    rng = random.Random(4)
    pairs = [(i if i % 9 else i // 2, [f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.randrange(9))], [f"s{i % 7}", f"l{i % 3}"]) for i in range(90)]
    df = spark.createDataFrame(pairs, "id long, words array<string>, tokens array<string>").dropDuplicates(["id"]).repartition(3)
    for bound in (1000, 50):
        chosen = vectors.training_pairs(df, bound)
        counted = vectors.frequencies(df, 2)
        plain = vectors.train(chosen, dim=8, epochs=4, batch=16, counted=counted)
        numbered = vectors.train(df, dim=8, epochs=4, batch=16, counted=counted, bound=bound)
        assert numbered.words == plain.words and np.array_equal(numbered.a, plain.a) and np.array_equal(numbered.b, plain.b)
    # rows that are left out of most steps, against all of them taken one by one
    x = np.random.default_rng(0).standard_normal((6, 4)).astype(np.float32)
    dense, m, v = x.astype(float), np.zeros((6, 4)), np.zeros((6, 4))
    adam = vectors._Adam(x, 0.05, 400)
    for t in range(1, 401):
        u = np.array([0, *([1] if t < 3 else []), *([2] if t % 7 == 0 else []), *([3] if t in (5, 390) else []), *([4] if t == 400 else [])])
        g = np.random.default_rng(t).standard_normal((len(u), 4)) * 1e-3
        adam.step(u, adam.rows(u), g.astype(np.float32))
        full = np.zeros((6, 4))
        full[u] = g
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        dense -= 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    adam.settle()
    assert np.abs(x - dense).max() < 1e-3
