"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import common, decontaminate, html_extract, language_id, license_scan, packing, quality_classifier, quality_rules, simhash, substring_dedup, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words string, kept string, key string, h string, words string, host string, symbols string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those used inside the operators."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in zip(ids, texts)], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


ODD = [None, "", " \t\n", "Über", "a", "ein Wort mehr", "x " * 3000, "\n\n\n"]


def components(n, edges):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
    expected = components(400, edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: expected[x] for x in touched}
    assert common.connected_components(df.where("false")).count() == 0


# --- op1


def brute_leaks(docs, items):
    out = {}
    for d, text in docs:
        dw = WORD.findall(lower(text or ""))
        for i, item in items:
            iw = WORD.findall(lower(item or ""))
            n, window = len(iw), min(len(iw), decontaminate.WINDOW)
            for g in range(-n + 1, len(dw)):
                equal = [0 <= g + k < len(dw) and dw[g + k] == iw[k] for k in range(n)]
                densest = max(sum(equal[k : k + window]) for k in range(n - window + 1))
                if densest >= (n if n < decontaminate.SEEDED else -(-6 * window // 10)) and sum(equal) > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (n, sum(equal), g)
    return out


def leak_case():
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.randrange(10, 50)))) for i in range(12)] + [(20, "too short an item"), (21, None), (22, ""), (23, "w3"), (24, "five words of an item"), (25, " ".join(words(rng, 7)))]
    docs = []
    for k in range(40):
        w = words(rng, 80)
        if k % 3 == 0:
            item = items[k % 12][1].upper().split()
            for j in range(4, len(item), 9):
                item[j] = "changed"
            w[30:30] = item
        if k % 7 == 0:
            w = items[k % 12][1].split()[1:] + w
        if k % 11 == 0:
            w[60:60] = "Five words of an item".split() if k % 2 else items[-1][1].split()
        docs.append((k, " ".join(w) if k % 2 else ", ".join(w)))
    return docs + [(90 + i, t) for i, t in enumerate(ODD)] + [(200, docs[0][1]), (201, docs[0][1])], items


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination_equals_brute_force(spark, limit):
    docs, items = leak_case()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("pos", F.lit(1)).withColumn("key", F.lit("x"))
    df = frame(spark, [t for _, t in docs], [d for d, _ in docs])
    got = {(r["doc_id"], r["item_id"]): (r["item_tokens"], r["matches"], r["doc_start"]) for r in decontaminate.leaks(df, bench, limit).collect()}
    assert got == brute_leaks(docs, items)
    assert len(got) > 15


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination_at_its_threshold(spark, limit):
    rng = random.Random(6)
    sizes = [8, 10, 15, 15, 17, 20, 25, 33]
    items = [(i, " ".join(words(rng, n, 5000))) for i, n in enumerate(sizes)]
    docs, planted = [], set()
    for i, item in items:
        w = item.split()
        n = len(w)
        least = -(-6 * n // 10)
        kept = [{j for j in range(n) if j % 3 != k} for k in range(3)]  # every third word replaced
        kept += [{j for j in range(n) if j % 5 in places} for places in ((0, 1, 3), (0, 2, 4), (1, 2, 4))]
        kept += [set(rng.sample(range(n), rng.randrange(least, max(least, 7 * n // 10) + 1))) for _ in range(30)]
        for keep in kept:
            if len(keep) >= least:
                planted.add((len(docs), i))
                docs.append((len(docs), " ".join([*words(rng, 20, 5000), *(t if j in keep else f"other{j}" for j, t in enumerate(w)), *words(rng, 20, 5000)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["item_tokens"], r["matches"], r["doc_start"]) for r in decontaminate.leaks(frame(spark, [t for _, t in docs]), bench, limit).collect()}
    assert set(got) >= planted
    assert got == brute_leaks(docs, items)


def test_long_items_leak_by_density_only(spark):
    rng = random.Random(16)
    long = " ".join(words(rng, 400, 12))
    part = long.split()[150:190]
    docs = [" ".join(words(rng, 400, 12)), " ".join([*words(rng, 90, 12), *part, *words(rng, 90, 12)]), " ".join([*words(rng, 50, 12), *part[:19], *words(rng, 50, 12)])]
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["item_tokens"], r["matches"], r["doc_start"]) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == brute_leaks(list(enumerate(docs)), [(1, long)]) and set(got) >= {(1, 1)} and (0, 1) not in got


def test_decontaminate_keeps_clean_rows(spark):
    docs, items = leak_case()
    df = frame(spark, [t for _, t in docs], [d for d, _ in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in brute_leaks(docs, items)}
    assert decontaminate.decontaminate(df, bench.where("false")).count() == df.count()
    assert decontaminate.leaks(df.where("false"), bench).count() == 0


def test_decontamination_is_native(spark):
    docs, items = leak_case()
    plan = decontaminate.leaks(frame(spark, [t for _, t in docs]), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op2

PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{}</style><script>var a="</p>";</script></head><body class=home>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="ad">Buy &amp; save a lot of money right now, and then some more of it.</div><aside class="sidebar"><p>Aside text, long enough to be taken for an article if one were careless.</p></aside>
<article class="post-17"><h1>Title &lt;one&gt;</h1><!-- <p>not this</p> --><p>First   paragraph,
with <b>bold</b><i>ness</i> and an<br>end. It has enough words to be the main text of this page.<p>Second paragraph follows, unclosed, with caf&eacute; &#8364;5 and &unknown; marks.
<div class="cookie-notice">We use cookies</div><ul><li>point one<li>point two</ul><form><p>Name</p></form></article>
<section id="comments"><p>A reader's comment that is really very long, longer than anything in the article, and goes on and on and on, to win by its length.</p></section><footer>&copy; all</footer></body></html>"""


def test_html_extraction(spark):
    other = PAGE.replace("post-17", "post-23")
    bare = "<p>Only one <b>paragraph"
    rows = [(1, "http://www.a.org/x", PAGE), (2, "http://a.org/y", other), (3, "https://b.org/", None), (4, None, ""), (5, "x", bare), (6, "http://a.org/z", "plain text &amp"), (7, "http://[", "<div>"), (2, "http://a.org/y", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("x")).withColumn("host", F.lit("x"))
    expected = "Title <one>\nFirst paragraph, with boldness and an end. It has enough words to be the main text of this page.\nSecond paragraph follows, unclosed, with café €5 and &unknown; marks.\npoint one\npoint two"
    for limit in (1000, 0):
        got = html_extract.extract(df, limit).collect()
        assert len(got) == len(rows)
        text = {r["page_id"]: r["text"] for r in got}
        assert text == {1: expected, 2: expected, 3: "", 4: "", 5: "Only one paragraph", 6: "plain text &", 7: ""}
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["path"] for r in got if r["host"] == "a.org"} == {"html/body.home/article.post-#"}
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_votes_overrule_a_page(spark):
    body = lambda a, b: f"<body><div class=main><p>{a}</p></div><div class=box><p>{b}</p></div></body>"
    rows = [(i, "http://h.org/", body("the article text " * 20, "short")) for i in range(5)] + [(9, "http://h.org/", body("brief article", "a longer box text " * 20))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief article"


PROSE = "Running text of an article that goes on for some time. "


@pytest.mark.parametrize(
    "inside",
    [
        "<h1>H</h1><section><p>{a}</p></section><section><p>{b}</p></section><section><p>{c}</p></section>",
        "<h1>H</h1><section class=one><p>{a}</p></section><div class=two><div><p>{b}</p></div></div><section class=three><p>{c}</p></section>",
        "<div><div><h1>H</h1></div><div class=deep><div><div><div><p>{a}</p><p>{b}</p></div></div></div></div></div><p>{c}</p>",
        "<h1>H</h1><p>{a}</p><div class=wrapper><p>{b}</p><p>{c}</p></div>",
    ],
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
def test_html_keeps_every_section(spark, inside, around):
    a, b, c = (("%s " % k + PROSE * n).strip() for k, n in (("a", 6), ("b", 20), ("c", 9)))
    page = "<html><body><nav><a href=/>Home</a></nav>" + around.format(inside.format(a=a, b=b, c=c)) + "<div class=box>A short remark.</div><div class=more><ul><li><a href=/1>" + PROSE * 9 + "</a></ul></div></body></html>"
    df = spark.createDataFrame([(i, "http://h.org/", page) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(df).collect()} == {"\n".join(["H", a, b, c])}


def test_html_joins_containers_at_one_path(spark):
    parts = [("%d " % k + PROSE * n).strip() for k, n in enumerate((2, 9, 1))]
    page = "<body>" + "".join(f"<article><p>{x}</p></article><div class=ad>{x}</div>" for x in parts) + "</body>"
    got = html_extract.extract(spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string")).first()
    assert got["text"] == "\n".join(parts)


BOILERPLATE = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>", '<div class="ad">Buy this now, it is very cheap today.</div>', "<form><p>Your name</p><input></form>",
    '<div id="cookie-notice">We use cookies on this site to please you.</div>', '<aside><p>Most read: something that is as long as a paragraph of the article is.</p></aside>', "<script>if (a < b) { '<p>no</p>' }</script>",
    '<div class="related-posts box"><a href=/x>More of this kind</a></div>', "<footer>&copy; 2024 All rights reserved</footer>", '<section class="comments"><p>First! A comment of a reader, who goes on at length about nothing much.</p></section>', "<!-- <p>never</p> -->",
]


def built_page(rng, k):
    """A page with markup of many kinds, and the text of its article."""
    blocks, out = [], []
    for _ in range(rng.randrange(1, 9)):
        text = " ".join(words(rng, rng.randrange(3, 60)))
        shown = text.replace("w1 ", "w1 &amp; ").replace("w2 ", "<b>w2</b> ").replace("w3 ", "w3\n  ").replace("w4 ", "<i class=x>w4</i>&nbsp;")
        blocks.append(" ".join(text.replace("w1 ", "w1 & ").split()))
        out.append(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<div class=related-work><p>{}</p></div>", "<section class='part p1'><p title=\"a > b\">{}</section>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>"]).format(shown))
        if rng.random() < 0.3:
            out.append(rng.choice(BOILERPLATE))
    around = [rng.choice(BOILERPLATE) for _ in range(4)]
    page = f"<html><head><title>t</title></head><body>{around[0]}<div class=wrap>{around[1]}<article class='post-{k} full'>{''.join(out)}</article>{around[2]}</div>{around[3]}</body></html>"
    return page, "\n".join(blocks)


def test_html_extraction_of_built_pages(spark):
    rng = random.Random(17)
    made = [built_page(rng, k) for k in range(300)]
    rows = [(k, f"https://h{k % 5}.org/p{k}", page) for k, (page, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [k for k, (_, text) in enumerate(made) if got[k] != text]
    assert not wrong, (len(wrong), made[wrong[0]], got[wrong[0]])


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="foo><p>Hello there</p></div>', "Hello there"),
        ('<div class="foo><p>Hello <a href="x">there</a></p></div>', "Hello there"),
        ("<article class=a><p>One two.</p></article><article class=a><p>Three.</p></article>", "One two.\nThree."),
        ("a < b and <b>c</b> 1<2", "a < b and c 1<2"),
        ("<p>cut off <a href='", "cut off"),
        ("<p title='a>b' >quoted</p><!-- open", "quoted"),
    ],
)
def test_html_with_broken_marks(page, text):
    best = html_extract.article(html_extract.parse(page))
    assert html_extract.text_at(page, best.path if best else None) == text


@pytest.mark.parametrize("bad", ['<a "', '<a x="y>', "<b>", "<p><table><b>", '<div class="x">', "<", "<a x='\"", "</p>", "<li>", "<!--"])
def test_html_reading_takes_linear_time(bad):
    import time

    page = bad * (200_000 // len(bad)) + "<div></div>" * 9_000
    began = time.process_time()
    html_extract.text_at(page, "x")
    assert time.process_time() - began < 6


# --- op3


def realised(node, rng):
    """Words that a template accepts, with its options and replaceable parts chosen at random."""
    if node.kind == "word":
        return [node.word]
    if node.kind == "any":
        return [f"zz{k}" for k in range(rng.randrange(node.n + 1))]
    if node.kind == "opt" and rng.random() < 0.5:
        return []
    parts = [rng.choice(node.parts)] if node.kind == "alt" else node.parts
    return [w for p in parts for w in realised(p, rng)]


@pytest.mark.parametrize("label", sorted(license_scan.TEMPLATES))
def test_every_wording_is_accepted_whole_only(label):
    rng = random.Random(label)
    for template in license_scan.TEMPLATES[label]:
        a, tree = license_scan.Automaton(template), license_scan.parse(template)
        for _ in range(20):
            w = realised(tree, rng)
            assert a.match([x.encode() for x in w], 0) == len(w)
            sure = [k for k, part in enumerate(tree.parts) if part.kind == "word"] if tree.kind == "seq" else []
            for k in rng.sample(sure, min(5, len(sure))):
                left = [x for j, part in enumerate(tree.parts) for x in (["altered"] if j == k else realised(part, rng))]
                assert a.match([x.encode() for x in left], 0) == -1 or template.endswith("]]")


def test_license_scan(spark):
    mit = " ".join(realised(license_scan.parse(license_scan.TEMPLATES["spdx:mit"][0]), random.Random(1)))
    texts = [*ODD, "Released under the MIT License.", "mit license MIT\nlicense", "x " + mit.upper() + " y", mit.replace("merge", "purge"), "LICENSED under the terms of the Apache License, Version 2.0!", "the apache license", "This fine work is licensed under the GNU General Public License, version 3.", "gnu general public licence", "licensed under CC-BY-NC 4.0", "licensed under cc by 4.0", "émit license"]
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t or ""))
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        padded = " " + "".join(x + " " for x in w)
        method = {x for x, ts in license_scan.TEMPLATES.items() if any(re.search(" " + license_scan.regex(license_scan.parse(y)), padded) for y in ts)}
        assert r["labels"] == ",".join(sorted({x for _, x in places} | method))
        assert r["score"] == (1.0 if method else 0.5 if places else 0.0)
    assert got[len(ODD) + 2]["labels"] == "spdx:mit" and got[len(ODD) + 3]["labels"] == ""
    assert license_scan.scan(df.where("false")).count() == 0


def test_template_markup():
    a = license_scan.Automaton("use [[of]] this (file|source code) {{2}} is free")
    ends = lambda s: a.match(s.encode().split(), 0)
    assert ends("use this file is free") == 5 and ends("use of this source code called x is free now") == 9
    assert ends("use this file a b c is free") == -1 and ends("use this is free") == -1
    for bad in ("a [[b", "a b]]", "[[a]]", "{{1}} a"):
        with pytest.raises(ValueError):
            license_scan.Automaton(bad)


# --- op4


def unpacked(rows, key=lambda r: r["doc_id"]):
    by = defaultdict(list)
    for r in rows:
        by[key(r)].append(r)
    return by


def test_packing_round_trip(spark):
    rng = random.Random(8)
    texts = [*ODD, *(" ".join(words(rng, rng.choice([1, 30, 300, 2500]))) for _ in range(60)), "<|endoftext|> is text", "\U0001f600 ñ ß  two   spaces \n\n"]
    df = frame(spark, texts).repartition(3)
    rows = packing.pack_documents(df).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json"))
    for d, pieces in unpacked(rows).items():
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    for pieces in unpacked(rows, lambda r: r["sequence_id"]).values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(df.where("false")).count() == 0


def test_packing_whole_examples_under_three_limits(spark):
    rng = random.Random(2)
    rows = [(i, t := rng.randrange(1, 200), rng.randrange(0, t + 1)) for i in range(300)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long").repartition(2)
    got = packing.pack_examples(df, tokens=256, segments=4, loss=128 + 72).collect()
    assert sorted(r["example_id"] for r in got) == sorted(i for i, _, _ in rows)
    of = {i: (t or 0, m or 0) for i, t, m in rows}
    for s in unpacked(got, lambda r: r["sequence_id"]).values():
        assert len(s) <= 4 and sum(of[r["example_id"]][0] for r in s) <= 256 and sum(of[r["example_id"]][1] for r in s) <= 200
    used = len({r["sequence_id"] for r in got})
    assert used <= 1.3 * max(sum(t for t, _ in of.values()) / 256, sum(m for _, m in of.values()) / 200, len(rows) / 4) + 4


def test_short_documents_leave_no_padding(spark):
    df = frame(spark, [f"w{i % 10}" for i in range(1000)]).repartition(1)
    of = unpacked(packing.pack_documents(df).collect(), lambda r: r["sequence_id"])
    sizes = sorted(sum(p["length"] for p in s) for s in of.values())
    assert sum(sizes) == 3000 and sizes[-2:] == [1024, 1024] and all(n & (n - 1) == 0 for n in sizes)


def test_packer_chooses_by_the_dot_product():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p = packing.Packer(tokens=100, segments=8, loss=60, pool=16, cut=False)
        for e in range(200):
            n = int(rng.integers(1, 60))
            loss = np.arange(n) < rng.integers(0, n + 1)
            before, room, held = list(p.waiting), p.room.copy(), len(p.sequence)
            list(p.add(packing.Piece(e, 0, np.zeros(n, np.uint8), loss, n)))
            if len(before) == 16 and len(p.sequence) == held + 1:
                asks = np.array([p._ask(x) for x in [*before, packing.Piece(e, 0, np.zeros(n, np.uint8), loss, n)]], float)
                worth = np.where((asks <= room).all(1), (asks / p.limits) @ (room / p.limits), -1)
                new = p.sequence[-1]
                assert np.isclose(worth.max(), (np.array(p._ask(new)) / p.limits) @ (room / p.limits))


def test_packing_of_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", " ".join(["w"] * ((c * 7 + t * 3) % 40 + 1))) for c in range(40) for t in range(1 + c % 5)] + [(None, 0, "user", "x"), (99, 0, "user", None), (98, 0, "user", "w " * 500), (97, 0, "assistant", "w " * 70)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    examples = packing.conversation_examples(turns, F.size(F.split(F.trim("text"), " ")), 128, 64)
    got = packing.pack_examples(examples, 128, 5, 64).collect()
    of = defaultdict(lambda: [0, 0])
    for c, _, role, t in rows:
        n = len((t or "").split())
        of[c][0] += n
        of[c][1] += n if role == "assistant" else 0
    assert {r["example_id"]: [r["n_tokens"], r["n_loss"]] for r in got} == {c: v for c, v in of.items() if c is not None and v[0] <= 128 and v[1] <= 64}
    for s in unpacked(got, lambda r: r["sequence_id"]).values():
        assert len(s) <= 5 and sum(r["n_tokens"] for r in s) <= 128 and sum(r["n_loss"] for r in s) <= 64
    assert packing.pack_examples(examples.where("false")).count() == 0


LARGE = [9007199254740993, None, -9223372036854775807, 7]


def test_large_ids_beside_null_ones_stay(spark):
    df = frame(spark, ["the cat sat on the mat"] * 4, LARGE).repartition(1)
    learnt = frame(spark, ["the cat sat", "on the mat"], [11, 12])
    results = {
        "license_scan": license_scan.scan(df), "packing": packing.pack_documents(df), "tokens": tokens.unigram_counts(df),
        "simhash": simhash.fingerprints(df), "language_id": language_id.identify(df, language_id.train(learnt)),
    }
    for name, out in results.items():
        assert {r["doc_id"] for r in out.collect()} == set(LARGE), name
    assert {r["component_id"] for r in simhash.components(df).collect()} == {LARGE[2]}
    assert {r["doc_id"] for r in simhash.deduplicate(df).collect()} == {LARGE[2], None}


def test_packer_cuts_under_a_loss_limit():
    p = packing.Packer(tokens=64, segments=3, loss=20, pool=4)
    rng, out = np.random.default_rng(1), []
    sizes = rng.integers(1, 200, 50).tolist()
    for e, n in enumerate(sizes):
        out += p.add(packing.Piece(e, 0, np.arange(n), rng.random(n) < 0.3, n))
    out += p.finish()
    assert all(sum(len(x.data) for x in s) <= 64 and len(s) <= 3 and sum(x.bearing for x in s) <= 20 for s in out)
    got = Counter()
    for s in out:
        for x in s:
            assert x.data[0] == x.start
            got[x.example] += len(x.data)
    assert got == dict(enumerate(sizes))


# --- op5


def test_quality_rules(spark):
    rng = random.Random(4)
    prose = lambda n: ". ".join(" ".join(words(rng, 9)).capitalize() for _ in range(n)) + "."
    texts = [prose(20) for _ in range(60)] + [" ".join(w + "###" for w in words(rng, 120)) for _ in range(8)] + [("LOUD WORDS HERE!! " * 60) for _ in range(4)] + ["a b c a b c d e f a b", "line\nline\n \nline\nother"] + ODD
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in quality_rules.assess(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = SPACE.findall(t)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 72))
    assert quality_rules.assess(df.where("false")).count() == 0
    plan = quality_rules.base_statistics(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_vote_model_equals_plain_em(spark):
    """The sums taken in Spark give the same rates as a loop over the patterns."""
    names = ["a", "b"]
    patterns = [(1, 1, 50), (-1, 0, 7), (-1, -1, 9), (0, 1, 20), (1, 0, 6)]
    model = quality_rules.fit(spark.createDataFrame(patterns, "a int, b int, n long"), names, rounds=5)
    p = [quality_rules.FAULTED if min(x[:2]) < 0 else quality_rules.UNFAULTED for x in patterns]
    for _ in range(5):
        rates = {}
        g, b = sum(q * x[2] for q, x in zip(p, patterns)), sum((1 - q) * x[2] for q, x in zip(p, patterns))
        for j, r in enumerate(names):
            rates[r] = []
            for y, total, share in (("g", g, p), ("b", b, [1 - q for q in p])):
                z = [max(quality_rules.LEAST, (sum(q * x[2] for q, x in zip(share, patterns) if x[j] == v) + quality_rules.IMAGINED[y][v + 1]) / (total + 1)) for v in (-1, 0, 1)]
                if y == "g":
                    z[0] = min(z[0], quality_rules.WRONG_AT_MOST)
                rates[r].append([v / sum(z) for v in z])
        prior = min(0.98, max(0.02, g / (g + b)))
        odds = [np.log(prior / (1 - prior)) + sum(np.log(rates[r][0][x[j] + 1] / rates[r][1][x[j] + 1]) for j, r in enumerate(names)) for x in patterns]
        p = [1 / (1 + np.exp(-o)) for o in odds]
    assert model["prior"] == pytest.approx(prior)
    for r in names:
        assert np.allclose(model["rates"][r], rates[r])


# --- op6


def held_out(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_quality_classifier_learns_and_scores_like_python(spark):
    rng = random.Random(6)
    texts, quality = [], []
    for _ in range(400):
        bad = rng.random() < 0.25
        w = words(rng, rng.randrange(20, 120))
        texts.append(" ".join(x + "$$" for x in w) if bad else " ".join(w) + ".")
        quality.append(int(not bad))
    df = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_classifier.classify(df, labels).collect()}
    assert len(rows) == len(texts) + len(ODD)
    assert all(rows[i]["held_out"] == held_out(i) and 0 <= rows[i]["score"] <= 1 and rows[i]["predicted"] == int(rows[i]["score"] >= 0.3) for i in rows)
    test = [i for i in range(400) if held_out(i)]
    assert sum(rows[i]["predicted"] == quality[i] for i in test) >= 0.97 * len(test)
    model = quality_classifier.train(df, labels)
    for r in quality_classifier.features(df, "doc_id").collect():
        x = np.array([[r[f] for f in quality_classifier.FEATURES]])
        z = model.intercept + sum(w for rule, w in model.rules if quality_classifier._holds(x, rule)[0])
        assert rows[r["doc_id"]]["score"] == pytest.approx(1 / (1 + np.exp(-z)))
    kept = quality_classifier.keep_good(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in rows if rows[i]["predicted"]}


def counted_features(text):
    """The classifier's features from their description, without Spark."""
    t = text or ""
    w, lines = SPACE.findall(t), t.split("\n")
    if not w:
        return [0.0] * 12
    share = lambda chars: sum(c in chars for c in t) / len(w)
    pairs = {(x, w[i + 1] if i + 1 < len(w) else None) for i, x in enumerate(w)}
    return [
        len(w), sum(map(len, w)) / len(w), share("#*$%&|<>"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!"), share(".?"), share(",;:"), share("0123456789"),
        len(set(w)) / len(w), len(w) / len(lines), len(set(lines)) / len(lines), 1 - len(pairs) / len(w),
    ]


def test_quality_features_equal_brute_force(spark):
    rng = random.Random(18)
    texts = [*ODD, *("\n".join(" ".join(rng.choice(["Ab", "c,d.", "9$!", "e", "É?"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))) for _ in range(60))]
    for r in quality_classifier.features(frame(spark, texts), "doc_id").collect():
        assert [r[f] for f in quality_classifier.FEATURES] == pytest.approx(counted_features(texts[r["doc_id"]])), texts[r["doc_id"]]


def test_repeated_documents_and_labels_are_learnt_from_once(spark):
    rows = [(i % 40, ["good words here.", "bad$$ words$$ here$$"][i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)] * 5, "doc_id long, quality int, toxic int")
    once = quality_classifier.train(df.dropDuplicates(["doc_id"]), labels.dropDuplicates(["doc_id"]))
    assert quality_classifier.train(df, labels) == once


def test_quality_classifier_never_sees_held_out_labels(spark):
    df = frame(spark, ["some words here"] * 50)
    flip = lambda q: spark.createDataFrame([(i, q if held_out(i) else i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(df, flip(0)) == quality_classifier.train(df, flip(1))
    assert {r["score"] for r in quality_classifier.classify(df, flip(0).where("false")).collect()} == {0.5}


# --- op7


def repeat_case():
    rng = random.Random(9)
    passage, variant_base = words(rng, 70, 5000), words(rng, 90, 5000)
    docs = []
    for k in range(60):
        w = words(rng, 100, 5000)
        if k % 4 == 0:
            w[37:37] = passage
        lines = [" ".join(w)]
        if k % 5 == 0:
            v = list(variant_base)
            if k % 10:
                v[(k * 7) % 90] = f"edit{k}"
            lines.append(" ".join(v))
        docs.append("\n".join(lines))
    return docs, passage, variant_base


def test_substring_dedup_finds_planted_repeats(spark):
    docs, passage, _ = repeat_case()
    rows = substring_dedup.spans(substring_dedup.repeats(frame(spark, docs + ODD))).collect()
    assert {r["doc_id"] for r in rows} == {k for k in range(60) if k % 4 == 0 or k % 5 == 0}
    assert {r["doc_id"] for r in rows if not r["kept"]} == {k for k in range(1, 60) if k % 4 == 0 or k % 5 == 0}


def test_substring_dedup_cuts_and_keeps(spark):
    docs, passage, base = repeat_case()
    df = frame(spark, docs + ODD)
    out = substring_dedup.deduplicate(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(docs) + len(ODD)
    assert sum(" ".join(passage) in r["text"] for r in got.values() if r["text"]) == 1
    for k in range(60):
        if k % 4 and k % 5:
            assert got[k]["text"] == docs[k]
        elif k:
            assert len(got[k]["text"]) < len(docs[k]) and got[k]["n_chars"] == len(got[k]["text"])
        if k % 5 == 0 and k:
            assert base[0] + " " + base[1] not in got[k]["text"]
    assert all(got[60 + i]["text"] == t for i, t in enumerate(ODD))
    assert substring_dedup.deduplicate(df.where("false")).count() == 0


@pytest.mark.parametrize("period", [1, 2, 3, 4, 7, 51])
def test_substring_dedup_finds_periodic_passages(spark, period):
    rng = random.Random(period)
    unit = words(rng, period, 5000)
    run = [unit[i % period] for i in range(51)]
    short = [" ".join(words(rng, 9, 5000)) for _ in range(30)]  # lines that are not banded
    docs = []
    for k in range(2):
        lines = "\n".join(" ".join(run[i : i + 9]) for i in range(0, 51, 9))
        docs.append("\n".join([*short[k * 15 : k * 15 + 7 + k], lines, *short[k * 15 + 8 : k * 15 + 15]]))
    rows = substring_dedup.spans(substring_dedup.repeats(frame(spark, [*docs, "\n".join(short[25:29])]))).collect()
    assert {(r["doc_id"], r["kept"]) for r in rows} >= {(0, True), (1, False)}


def test_shared_words_hold_a_common_passage():
    rng = random.Random(4)
    held = substring_dedup.ANCHOR + substring_dedup.PASSAGE_WORDS - 1
    assert held <= 51
    for k in range(400):
        run = [f"r{rng.randrange(1 + k % 5)}" for _ in range(held)]
        found = []
        for _ in range(2):
            text = words(rng, rng.randrange(60), 1 + k % 9) + run + words(rng, rng.randrange(60), 1 + k % 9)
            p = substring_dedup._paragraphs("\n".join(text))
            found.append(set(p.h[: len(p.h) - len(p.bands)].tolist()))
        assert found[0] & found[1]


def test_similar_lines_equal_brute_force_components(spark):
    rng = random.Random(1)
    base = words(rng, 120, 5000)
    texts = []
    for k in range(50):
        v = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            v[rng.randrange(120)] = f"e{rng.randrange(50)}"
        texts.append(" ".join(v))
    texts += [" ".join(words(rng, 60, 5000)) for _ in range(10)]
    rows = substring_dedup.repeats(frame(spark, texts)).where("words > 20").collect()
    sh = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    truth = components(60, [(a, b) for a, b in combinations(range(60), 2) if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])])
    groups = Counter(truth)
    assert {r["doc_id"] for r in rows} == {d for d in range(60) if groups[truth[d]] > 1}
    classes = defaultdict(set)
    for r in rows:
        classes[r["class_id"]].add(r["doc_id"])
    assert sorted(map(sorted, classes.values())) == sorted(sorted(d for d in range(60) if truth[d] == c) for c in groups if groups[c] > 1)


def families(rng):
    """Lines of families whose members mostly aren't like their best copied one: rewritten, cut off, lengthened, of a shared passage."""
    for kind in range(12):
        base, passage = words(rng, rng.randrange(60, 140), 5000), words(rng, 30, 5000)
        for k in range(30):
            v = list(base)
            if kind % 4 == 0:
                for _ in range(rng.randrange(9)):
                    v[rng.randrange(len(v))] = f"e{rng.randrange(40)}"
            elif kind % 4 == 1:
                v = v[: rng.randrange(25, len(v))]
            elif kind % 4 == 2:
                v += words(rng, rng.randrange(60), 5000)
            else:
                v = passage + words(rng, 2 + k, 30)
            yield " ".join(v)


def test_no_link_of_a_bucket_is_lost(spark):
    rng = random.Random(8)
    texts = list(dict.fromkeys(families(rng)))
    parts = [substring_dedup._paragraphs(t) for t in texts]
    line = [int(p.h[-1].view(np.int64)) for p in parts]
    buckets = defaultdict(set)
    for i, p in enumerate(parts):
        for key in p.bands[0].tolist():
            buckets[key].add(i)
    sh = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    met = {pair for b in buckets.values() for pair in combinations(sorted(b), 2)}
    links = [(a, b) for a, b in met if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])]
    df = frame(spark, texts)
    classes = substring_dedup.paragraphs(df).where("bands is not null").selectExpr("h", "1L as n", "doc_id", "start", "words", "bands")
    got = substring_dedup.similar_lines(df, classes).collect()
    at = {h: i for i, h in enumerate(line)}
    found = [(at[r["a"]], at[r["b"]]) for r in got]
    assert set(map(frozenset, found)) <= set(map(frozenset, links))
    assert components(len(texts), found) == components(len(texts), links)
    assert len(met) > 5 * len(links)


def test_substring_dedup_keeps_columns_of_any_name(spark):
    docs, _, _ = repeat_case()
    df = frame(spark, docs).selectExpr("doc_id", "text", "n_chars", "lang as cut", "h as row", "source as id", "h as `_text`", "h as `_cut`", "words as `a.b`")
    out = substring_dedup.deduplicate(df)
    assert out.columns == df.columns and out.count() == len(docs)
    assert {r["_text"] for r in out.collect()} == {"x"}


def test_substring_dedup_of_rows_without_or_with_one_id(spark):
    docs, _, _ = repeat_case()
    same = [docs[0], docs[4], docs[0]]  # rows of one id are one document
    got = substring_dedup.deduplicate(frame(spark, [*same, docs[8]], [None, None, 7, 7])).collect()
    assert sorted(r["text"] for r in got) == sorted([*same, docs[8]])


# --- op8


@pytest.mark.parametrize("dense", [language_id.DENSE, 0])
@pytest.mark.parametrize("letters", ["abcd ", "".join(chr(0x4E00 + i) for i in range(300)) + "жз "])
def test_suffix_automaton_parses_like_brute_force(letters, dense):
    rng = random.Random(11)
    fold = language_id.fold
    sample = "".join(rng.choice(letters) for _ in range(500 + 4 * len(letters)))
    model = language_id.LanguageModel({"x": fold(sample), "y": fold(sample[::-1] + " q")}, dense)
    texts = ["".join(rng.choice(letters + "eж") for _ in range(n)) for n in [1, 7, 100, 3000, *(rng.randrange(60) for _ in range(60))]] + ["", "e", "eae", "12"]

    def phrases(text, data):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in data:
                k += 1
            n, i = n + 1, i + max(1, k - 1)
        return n

    decode = lambda a: "".join(map(chr, a))
    got = model.phrases([fold(t) for t in texts])
    for t, row in zip(texts, got):
        t = decode(fold(t))
        assert row.tolist() == [phrases(t, decode(fold(s))) for s in (sample, sample[::-1] + " q")]


def test_language_samples_are_whole_texts_up_to_the_bound(spark):
    rows = [(i, "x" * 50, "aa") for i in range(100)] + [(200 + i % 3, "y" * 30, "bb") for i in range(60)] + [(400, "-" * 90 + "z" * 900, "cc"), (401, "123 !", "cc")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 500)
    of = dict(zip(model.languages, model.bits))
    held = {200 + i for i in range(3) if held_out(200 + i)}
    n = 3 - len(held)
    assert of["aa"] == np.log2(500 + 9) and (n == 0 or of["bb"] == np.log2(30 * n + n - 1))
    assert held_out(400) or 2 ** of["cc"] > 400


def test_language_id(spark):
    rng = random.Random(12)
    kinds = {"aa": "the of and to in that is was".split(), "bb": "der die und das ist nicht ein zu".split()}
    rows = [(i, " ".join(rng.choice(kinds[g]) for _ in range(30)), g) for i in range(200) for g in [("aa", "bb")[i % 2]]]
    rows += [(300, None, "aa"), (301, "12 34 !", "aa"), (302, "Zu der und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("x")).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(got[i]["lang_pred"] == g and got[i]["held_out"] == held_out(i) and 0 < got[i]["score"] <= 1 for i, _, g in rows[:200])
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und", "und", "bb"]
    assert language_id.identify(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- op9


def test_unigram_trie_equals_exhaustive_search():
    pieces = {"a": -1.5, "b": -2.0, "ab": -2.1, "bc": -2.5, "abc": -4.0, "c": -3.0, "▁": -1.0, "▁a": -1.7}
    trie = tokens.UnigramTrie(pieces, nodes=40)

    def best(word):
        if not word:
            return 0.0, 0
        found = [(pieces[word[:k]] + s, 1 + n) for k in range(1, len(word) + 1) if word[:k] in pieces for s, n in [best(word[k:])]]
        if word[0] not in pieces:
            s, n = best(word[1:])
            found.append((trie.unknown + s, len(word[0].encode()) + n))
        return max(found, key=lambda x: (round(x[0], 9), -x[1]))

    alone = tokens.UnigramTrie(pieces, long=0)  # every word by itself
    rng = random.Random(13)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("aabbcé") for _ in range(rng.randrange(9)))
        assert trie(w) == alone(w) == best(w)[1], w
    w = "".join(rng.choice("abc") for _ in range(300_000))
    assert trie(w) > 0 and len(trie.best) <= 40  # a word without end leaves no nodes


def test_token_counts(spark):
    texts = [*ODD, "the cat the cat", "zażółć gęślą"]
    rows = {r["doc_id"]: r for r in tokens.unigram_counts(frame(spark, texts)).collect()}
    trie = tokens.UnigramTrie(tokens.zipf_pieces())
    for i, t in enumerate(texts):
        w = SPACE.findall(t or "")
        assert (rows[i]["n_words"], rows[i]["n_distinct_words"], rows[i]["n_tokens"]) == (len(w), len(set(w)), sum(trie("▁" + x) for x in w))
    assert tokens.unigram_counts(frame(spark, texts).where("false")).count() == 0


# --- op10


def brute_fingerprint(text):
    w = SPACE.findall(lower(text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_components_equal_brute_force(spark, bucket):
    rng = random.Random(14)
    base = words(rng, 150)
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(150)] = f"e{k}"
        texts.append(" ".join(w))
    texts += [" ".join(words(rng, rng.randrange(1, 30), 20)) for _ in range(40)] + texts[:5] + ODD
    ids = [1000 - i for i in range(len(texts))]
    rows = {r["doc_id"]: r for r in simhash.components(frame(spark, texts, ids), bucket).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    edges = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    group = components(len(texts), edges)
    least = {g: min(ids[i] for i in range(len(texts)) if group[i] == g) for g in set(group)}
    for i in range(len(texts)):
        assert rows[ids[i]]["fp"] & (1 << 64) - 1 == fp[i]
        assert rows[ids[i]]["component_id"] == least[group[i]]


def test_simhash_links_near_fingerprints_in_either_way(spark):
    rng = random.Random(15)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for f in list(fps):
        for _ in range(4):
            g = f
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << bit
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    truth = components(len(signed), [(a, b) for a, b in combinations(range(len(signed)), 2) if ((signed[a] ^ signed[b]) & (1 << 64) - 1).bit_count() <= 4])
    for bucket in (64, 1):
        at = {f: i for i, f in enumerate(signed)}
        got = components(len(signed), [(at[r["a"]], at[r["b"]]) for r in simhash.links(df, bucket).collect()])
        assert got == truth


def test_simhash_deduplicate(spark):
    df = frame(spark, ["same words are here", "same words are here", None, "", "quite another thing", None], [5, 3, 9, 8, 1, 8])
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 8, 8]
    assert simhash.deduplicate(df.where("false")).count() == 0


def test_simhash_deduplicate_keeps_rows_without_an_id(spark):
    df = frame(spark, ["nothing is like this text", "same words are here", "same words are here", "same words are here", "a group without ids", "a group without ids", None], [None, None, 4, 7, None, None, None])
    out = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(df).collect()]
    assert sorted(out, key=repr) == sorted([(4, "same words are here"), *((None, t) for t in ("nothing is like this text", "same words are here", "a group without ids", "a group without ids", None))], key=repr)
