"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are cut two ways, over words that are runs of ASCII letters, digits and
non-ASCII characters, A-Z in lower case:

- lines of at least LINE_WORDS words. Equal lines are one class; classes are banded by
  MinHash over five-word shingles, colliding ones are compared by exact Jaccard similarity
  of their shingle sets, and components of similar classes are copies of each other;
- passages: PASSAGE_WORDS words from each anchor on, anchors being the places where a hash of two
  words is smallest in a window of ANCHOR places (winnowing). They find every passage of
  ANCHOR + PASSAGE_WORDS - 1 words or more wherever it stands in a line, periodic ones
  too, and are banded by one key, their whole word sequence.

A paragraph found in several documents stays in the one with the smallest id. Words are
told apart by 64 bits, paragraphs by two independent hashes of 96 bits together; nothing is
cut unless both agree. A line of fewer than LINE_WORDS words is a copy only as a part of a
longer passage: phrases so short recur in texts that have nothing else in common.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, join_hot, materialise, release

SHINGLE, SIMILARITY = 5, 0.8
LINE_WORDS, PASSAGE_WORDS, ANCHOR = 20, 20, 17
#: Six bands of three rows find a pair at similarity 0.8 with probability 0.986, at 0.9 with 0.9996.
BANDS, ROWS = 6, 3

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PLACED = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Paragraphs leave a worker in batches of about so many rows.
_ROWS = 50_000
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _rolled(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * _BASE + w[k : len(w) - n + 1 + k]
    return _mix(h)


def line_words(text: str) -> tuple[np.ndarray, list[int]]:
    """Hashes of all words, and the number of words before each line's end."""
    words: list[bytes] = []
    ends = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        words += _WORD.findall(line)
        ends.append(len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), ends


def anchors(w: np.ndarray) -> np.ndarray:
    """Places of the smallest two-word hash, the last of equal ones, of every ANCHOR places in a row where a passage can begin.

    Which place is taken depends on these words only. So ANCHOR + PASSAGE_WORDS - 1 words
    that two texts share, whatever they are, hold a passage of both.
    """
    h = _rolled(w, 2)[: max(0, len(w) - PASSAGE_WORDS + 1)]
    if not len(h):
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    # of equal hashes the last is smallest, as the places below them count down
    least = h & ~low | low - np.arange(len(h), dtype=np.uint64)
    width, wanted = 1, min(ANCHOR, len(h))
    while width < wanted:
        step = min(width, wanted - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = (low - (least & low)).astype(np.int64)
    return at[np.diff(at, prepend=-1) > 0]


class Paragraphs(NamedTuple):
    """Of one text, passages before lines. bands has a row for each line."""

    start: np.ndarray
    words: np.ndarray
    h: np.ndarray
    g: np.ndarray
    bands: np.ndarray


def _upper(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _paragraphs(text: str) -> Paragraphs:
    w, ends = line_words(text)
    at = anchors(w)
    h, g = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(PASSAGE_WORDS if len(at) else 0):
        h, g = h * _BASE + w[at + k], g * _BASE2 + w[at + k]
    h, g = _mix(h), _upper(_mix(g))
    lines = np.array([(a, b) for a, b in zip([0, *ends], ends) if b - a >= LINE_WORDS], np.int64).reshape(-1, 2)
    keys = np.zeros((BANDS, len(lines)), np.uint64)
    if len(lines):
        sh = _rolled(w, SHINGLE)
        size = lines[:, 1] - lines[:, 0]
        # shingles of each line follow one another in ``own``, so that one reduceat takes all minima
        own = np.concatenate([sh[a : b - SHINGLE + 1] for a, b in lines.tolist()])
        cuts = np.cumsum(size - SHINGLE + 1) - (size - SHINGLE + 1)
        for band in range(BANDS):
            for r in range(band * ROWS, band * ROWS + ROWS):
                keys[band] = keys[band] * _BASE + np.minimum.reduceat(own * _MULTIPLY[r] + _ADD[r], cuts)
            keys[band] = _mix(keys[band] + np.uint64(band))
        whole = np.concatenate([w[a:b] for a, b in lines.tolist()])
        first = np.cumsum(size) - size
        place = (np.arange(len(whole)) - np.repeat(first, size) + 1).astype(np.uint64)
        h = np.concatenate([h, _mix(np.add.reduceat(_mix(_mix(whole) + place * _BASE), first))])
        g = np.concatenate([g, _upper(_mix(np.add.reduceat(_mix(_mix(whole) ^ place * _BASE2), first)))])
    return Paragraphs(np.concatenate([at, lines[:, 0]]), np.concatenate([np.full(len(at), PASSAGE_WORDS), lines[:, 1] - lines[:, 0]]), h, g, keys.T)


def _arrow(ids: list[int], parts: list[Paragraphs]) -> pa.RecordBatch:
    flat = lambda f, kind: np.concatenate([getattr(p, f) for p in parts]).astype(kind, copy=False)
    counts = np.concatenate([np.r_[np.zeros(len(p.h) - len(p.bands), np.int64), np.full(len(p.bands), BANDS)] for p in parts])
    bands = pa.ListArray.from_arrays(
        np.r_[0, np.cumsum(counts)].astype(np.int32),
        np.concatenate([p.bands.ravel() for p in parts]).view(np.int64),
        mask=pa.array(counts == 0),
    )
    columns = [np.repeat(np.array(ids, np.int64), [len(p.h) for p in parts]), flat("start", np.int32), flat("words", np.int32), flat("h", np.uint64).view(np.int64), flat("g", np.int32), bands]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "start", "words", "h", "g", "bands"])


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, start (in words), words, h, g, bands (null for passages). Rows without an id are left out."""

    def run(batches):
        for b in batches:
            ids, parts, rows = [], [], 0
            for d, t in zip(b.column("doc_id"), b.column("text")):
                p = _paragraphs(t.as_py() or "")
                if len(p.h):
                    ids.append(d.as_py()), parts.append(p)
                    rows += len(p.h)
                if rows > _ROWS:
                    yield _arrow(ids, parts)
                    ids, parts, rows = [], [], 0
            if parts:
                yield _arrow(ids, parts)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start int, words int, h long, g int, bands array<long>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, shingles) of the lines (h, doc_id, start, words): the sorted set of shingle hashes."""
    lines = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "words")).alias("lines"))

    def run(batches):
        for b in batches:
            rows = []
            for text, lines in zip(b["text"], b["lines"]):
                w, _ = line_words(text)
                rows += [(x["h"], np.unique(_rolled(w[x["start"] : x["start"] + x["words"]], SHINGLE)).view(np.int64)) for x in lines]
            yield pd.DataFrame(rows, columns=["h", "shingles"])

    found = docs.where("doc_id is not null").select("doc_id", "text").join(lines, "doc_id").select("text", "lines")
    return found.mapInPandas(run, "h long, shingles array<long>").dropDuplicates(["h"])


def _sided(own: str, other: str, side: int) -> Column:
    return F.transform(F.array_except(own, other), lambda x: F.struct(F.lit(side).alias("side"), x.alias("e")))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with na, nb, the sizes of their sets, and delta, what only one of them has: (0, x) for a, (1, x) for b."""
    j = pairs.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("sb")), "b")
    return j.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.concat(_sided("sa", "sb", 0), _sided("sb", "sa", 1)).alias("delta"))


def _similar() -> Column:
    """Whether the Jaccard similarity of a compared pair is SIMILARITY or more."""
    both = (F.col("na") + F.col("nb") - F.size("delta")) / 2
    return both >= SIMILARITY * (both + F.size("delta"))


def _unpaired(star: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with one pivot, one of them at least unlike it, that may be similar; ``star`` as in :func:`similar_lines`."""
    k = (1 - SIMILARITY) / (1 + SIMILARITY)
    n, own, at = F.col("n"), F.col("na"), F.col("nb")
    split = star.where("not similar").select("b").distinct()
    lost = F.size(F.filter("delta", lambda x: x["side"] == 1))
    parts = star.join(split, "b", "left_semi").select("b", "a", "similar", "na", "nb", F.size("delta").alias("n"), lost.alias("lost"), F.explode("delta").alias("d")).select("*", "d.side", "d.e").drop("d")
    known = parts.groupBy("b", "e").agg(F.count("*").alias("df"))
    order = Window.partitionBy("b", "a").orderBy("df", "e")
    placed = parts.join(known, ["b", "e"]).select("*", F.row_number().over(order).alias("r"), (F.col("lost") - F.sum("side").over(order)).alias("lost_after"))
    placed = placed.withColumn("new_after", n - F.col("r") - F.col("lost_after")).where("df > 1")
    # places up to which a partner of either kind has its first common element, by the least overlap that it needs
    with_unlike = F.col("r") <= n - F.floor((n - k * own + k * at) / 2 - 1e-9)
    with_similar = F.col("r") <= n - F.greatest(F.lit(1), F.ceil((n - k * (own + at) + (1 - k)) / 2 - 1e-9)) + 1

    def side(kind: Column, name: str) -> DataFrame:
        return placed.where(kind).select("b", "e", *[F.col(c).alias(name + c) for c in ("a", "n", "na", "lost_after", "new_after")])

    def met(x: DataFrame, y: DataFrame, once: Column) -> DataFrame:
        # the rows of a pair's first common element keep it: there, what comes after bounds the rest of the overlap
        most = 1 + F.least("xnew_after", "ynew_after") + F.least("xlost_after", "ylost_after")
        possible = F.col("xn") + F.col("yn") - 2 * most <= k * (F.col("xna") + F.col("yna")) + 1e-9
        return x.join(y, (x["b"] == y["b"]) & (x["e"] == y["e"]) & once & possible).select(F.least("xa", "ya").alias("a"), F.greatest("xa", "ya").alias("b"))

    unlike = ~F.col("similar") & with_unlike
    among = met(side(unlike, "x"), side(unlike, "y"), F.col("xa") < F.col("ya"))
    across = met(side(~F.col("similar") & with_similar, "x"), side(F.col("similar") & with_unlike, "y"), F.col("xa") != F.col("ya"))
    return among.union(across).distinct()


def similar_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes of lines (h, n, doc_id, start, words, bands).

    In every bucket the class with most bucket mates is the pivot, as a text that others
    vary has more of them than its variants, and all others are compared with it. That
    leaves the links of those unlike their pivot. Let D(x) be what only one of x and the
    pivot p has, and k = (1 - s) / (1 + s) for the similarity s: x and y are similar if
    |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= k (|x| + |y|). If c is unlike the
    pivot, |D(c)| > k (|c| + |p|), so a partner y shares over (|D(y)| - k |y| + k |p|) / 2
    of D(y) with it, and c shares as much of D(c) with a partner that is unlike the pivot
    too, or at least (|D(c)| - k (|c| + |p|) + 1 - k) / 2 with one that is similar to it.
    Sets with so much in common share an element among the first ones of both, in the
    order: held by fewest members, smallest hash. At the first common element the elements
    after it, new ones and those that only the pivot has each by themselves, bound the
    rest of the overlap; only pairs that can still reach what they need are compared.
    So neither variants of one text nor texts without anything in common are paired up,
    and no pair that banding has brought together loses its link.
    """
    filed = classes.select("h", "n", F.explode("bands").alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = materialise(filed.join(sizes, "key"), "shared")
    release(docs.sparkSession)
    mates = shared.groupBy("h").agg(F.sum("m").alias("mates"))
    pivots = shared.join(mates, "h").groupBy("key").agg(F.max(F.struct("mates", "n", "h")).alias("p")).select("key", F.col("p.h").alias("pivot"))
    met = materialise(shared.join(pivots, "key").select("pivot", "h").distinct(), "buckets")
    sets = materialise(_shingle_sets(docs, classes.join(met.select("h").distinct(), "h", "left_semi").select("h", "doc_id", "start", "words")), "shingles")
    star = materialise(_compared(met.where("h <> pivot").select(F.col("h").alias("a"), F.col("pivot").alias("b")), sets).withColumn("similar", _similar()), "stars")
    return star.where("similar").select("a", "b").union(_compared(_unpaired(star), sets).where(_similar()).select("a", "b"))


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated paragraphs: doc_id, start, words, class_id, kept; one row for each place of each.

    kept is true in the document with the smallest id that holds the class. Only what
    stands in two or more documents counts. Null and empty texts and rows without an id
    have no rows; two rows of one id are one document; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    units = materialise(paragraphs(docs), "paragraphs")
    passages = units.where("bands is null").select("h", "g", "doc_id", "start")
    held = [F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")]
    twice = materialise(passages.groupBy("h", "g").agg(*held).where("first < last").drop("last"), "passages")
    release(spark)
    lines = units.where("bands is not null").select("h", "g", "doc_id", "start", "words", "bands")
    # lines with one h and unequal g, if there should be any, count as unrepeated
    alike = lines.groupBy("h").agg(F.min("g").alias("g"), F.max("g").alias("g2"), *held, F.min(F.struct("doc_id", "start", "words")).alias("at"), F.first("bands").alias("bands"))
    classes = materialise(alike.where("g = g2").select("h", "g", "n", "first", "last", "at.*", "bands"), "classes")
    del alike
    links = materialise(similar_lines(docs, classes), "links")
    release(spark)
    group = connected_components(links)
    placed = classes.join(group, classes["h"] == group["node"], "left").where("component is not null or first < last")
    of = materialise(placed.select("h", "g", "n", "first", "last", F.coalesce("component", "h").alias("class_id")), "members")
    spread = of.groupBy("class_id").agg(F.min("first").alias("least"), F.max("last").alias("most")).where("least < most")
    copied = materialise(of.join(spread, "class_id").select("h", "g", "n", "class_id", F.col("least").alias("first")), "copied")
    release(spark)
    found = join_hot(passages, twice, ["h", "g"], "n").select("doc_id", "start", F.lit(PASSAGE_WORDS).alias("words"), F.col("h").alias("class_id"), "first")
    found = found.unionByName(join_hot(lines.drop("bands"), copied, ["h", "g"], "n").select("doc_id", "start", "words", "class_id", "first"))
    return found.select("doc_id", "start", "words", "class_id", (F.col("doc_id") == F.col("first")).alias("kept"))


def spans(found: DataFrame) -> DataFrame:
    """Overlapping and touching paragraphs of :func:`repeats` as spans: doc_id, start, words, class_id (the smallest), kept."""
    placed = found.groupBy("doc_id", "kept").agg(F.array_sort(F.collect_list(F.struct("start", "words", "class_id"))).alias("all"))

    def run(batches):
        for b in batches:
            rows = []
            for doc, kept, parts in zip(b["doc_id"], b["kept"], b["all"]):
                first, end, cls = None, -1, 0
                for p in parts:
                    if p["start"] > end:
                        if first is not None:
                            rows.append((doc, first, end - first, cls, kept))
                        first, end, cls = p["start"], p["start"] + p["words"], p["class_id"]
                    end, cls = max(end, p["start"] + p["words"]), min(cls, p["class_id"])
                rows.append((doc, first, end - first, cls, kept))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "words", "class_id", "kept"])

    return placed.mapInPandas(run, "doc_id long, start long, words long, class_id long, kept boolean")


def without(text: str, cut: list[tuple[int, int]]) -> str:
    """``text`` without the spans (start, words), each from its first word to the next word after it."""
    places = [m.start() for m in _PLACED.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, words in sorted(cut):
        a, b = places[start], places[min(start + words, len(places) - 1)]
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def deduplicate(docs: DataFrame) -> DataFrame:
    """Texts without the repeats that another document keeps; all columns, n_chars brought up to date.

    A document of which no word is left is dropped; one that had none stays. Rows without
    an id stay as they are. Columns of any name are fine.
    """
    schema = docs.schema
    cuts = materialise(spans(repeats(docs)).where("not kept").groupBy("doc_id").agg(F.collect_list(F.struct("start", "words")).alias("cut")), "cuts")
    release(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(cuts, rows["id"] == cuts["doc_id"], "left").select("row", "cut")

    @F.pandas_udf("string")
    def shorter(text: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([t if c is None or t is None else without(t, [(x["start"], x["words"]) for x in c]) for t, c in zip(text, cut)], dtype=object)

    shorter = shorter.asNondeterministic()  # else the filter below would run it a second time
    uncut = F.col("cut").isNull()
    new = joined.withColumn("text", F.when(uncut, F.col("row.text")).otherwise(shorter("row.text", "cut")))
    new = new.where(uncut | F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    old = {c: F.col("row").getField(c) for c in docs.columns}
    values = old | {"text": F.col("text")} | ({"n_chars": F.when(uncut, old["n_chars"]).otherwise(F.length("text"))} if "n_chars" in old else {})
    return new.select(*[values[c].cast(schema[c].dataType).alias(c) for c in docs.columns])
