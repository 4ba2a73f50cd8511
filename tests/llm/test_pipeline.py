"""The pipeline on a small corpus against brute force, stage by stage."""

import random
import zlib
from itertools import combinations

import numpy as np
from test_corpus_operators import brute_fingerprint, brute_leaks, components, words

import corpus_pipeline
from lexiloom.llm import quality_classifier, tokens


def corpus(tmp_path, spark):
    rng = random.Random(21)
    passage = " ".join(words(rng, 60, 5000))
    items = [(i, " ".join(words(rng, 30, 5000))) for i in range(3)]
    texts, quality = [], {}
    for i in range(160):
        w = words(rng, 120, 5000)
        if i % 4 == 3:
            w = [x + "$$" for x in w]
        elif i % 10 == 0:
            w[50:50] = passage.split()
        elif i % 17 == 0:
            w[20:20] = items[i % 3][1].split()
        quality[i] = int(i % 4 != 3)
        texts.append(" ".join(w) + ".")
    texts += [texts[1], texts[2].replace(" ", "  "), None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t), i % 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, symbols int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return passage, items


def test_stages(spark, tmp_path):
    passage, items = corpus(tmp_path, spark)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash", "substring_dedup", "decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        rows = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality_classifier":
            scored = quality_classifier.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
            expected = {r["doc_id"] for r in scored if r["predicted"] == 1}
            assert {i for i in range(160) if i % 4 != 3} <= expected and not {i for i in range(160) if i % 4 == 3} & expected
        elif name == "simhash":
            ids = sorted(before)
            fp = [brute_fingerprint(before[i]) for i in ids]
            group = components(len(ids), [(a, b) for a, b in combinations(range(len(ids)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
            expected = {ids[g] for g in set(group)}
        elif name == "substring_dedup":
            assert sum(passage in (t or "") for t in before.values()) > 1 == sum(passage in (t or "") for t in after.values())
            clean = {i for i, t in before.items() if passage not in (t or "") and i % 17}
            assert all(after[i] == before[i] for i in clean if i in after)
            expected = set(before)
        else:
            leaking = {x for x, _ in brute_leaks(list(before.items()), items)}
            assert leaking
            expected = set(before) - leaking
        assert set(after) == expected, name
        if name != "substring_dedup":
            assert all(after[i] == before[i] for i in after)
        before = after
    encode = tokens.BpeEncoder.load()
    for i, t in before.items():
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = encode(t or "", 0)
        assert sum(p["length"] for p in pieces) == len(ids) == pieces[0]["doc_tokens"]
        assert all(p["ids_crc32"] == zlib.crc32(np.asarray(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in pieces)
    assert {r["doc_id"] for r in rows} == set(before)
    key = lambda r: (r["doc_id"], r["start"])
    whole = corpus_pipeline.run(spark, d).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in rows) and len({key(r) for r in whole}) == len(whole)
