"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the tokens that a mask selects; the positions that it leaves out may
differ. Seeds of the benchmark are looked up for every position of every document, and
around each hit the item is laid over the document without gaps and compared token by
token, so substituted tokens cost what they cover and no more. All is DataFrame
expressions. The tokens of a document ride along in its row, so against a benchmark of
checked size there is no shuffle before the few pairs found are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_of

#: 1: compared; 0: left out. All ways to take three of five tokens in a row, first one included: a window
#: of 8 tokens or more with SHARE in place has three matches in some five in a row, and so a hit.
MASKS = ("111", "1101", "11001", "1011", "10101", "10011")
#: A document leaks an item if, of WINDOW places of the item in a row (of all, if it has fewer), so large a part is found in place.
SHARE, WINDOW = 0.6, 33
#: Items of fewer tokens are looked up whole, by the hash of all their tokens, and must stand in the document exactly.
SEEDED = 8
#: The benchmark is broadcast up to so many seeds (of three numbers each) and tokens; beyond, joins shuffle.
BROADCAST_SEEDS, BROADCAST_TOKENS = 2_000_000, 2_000_000


def tokens_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return F.array_remove(F.split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _seeds(df: DataFrame, tokens: str, masks: dict[str, Column], *keep: str) -> DataFrame:
    """``keep``, pos (from 0) and key: a row for each mask and position at which it fits, if the mask's condition holds."""
    span = max(map(len, masks))
    size = F.greatest(F.size(tokens), F.lit(1))
    shifted = F.arrays_zip(*[F.slice(F.col(tokens), i + 1, size).alias(f"t{i}") for i in range(span)])
    keys = []
    for mask, condition in masks.items():
        picked = [F.col(f"t.t{i}") for i, m in enumerate(mask) if m == "1"]
        keys.append(F.when(picked[-1].isNotNull() & condition, F.xxhash64(F.lit(int("1" + mask, 2)), *picked)))
    at = df.select(*keep, F.size(tokens).alias("n"), F.posexplode(shifted).alias("pos", "t"))
    return at.select(*keep, "pos", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def _places(diag: Column, item: Column, doc: Column) -> Column:
    """The places of ``item`` whose tokens are equal, with it laid over ``doc`` from place ``diag`` on, which may be negative."""
    return F.filter(F.transform(item, lambda a, i: F.when(a == F.get(doc, i + diag), i)), lambda i: i.isNotNull())


def _matches(diag: Column, item: Column, doc: Column) -> Column:
    """How many those are, from the part of both that lies over the other: most hits end here."""
    skip = F.greatest(-diag, F.lit(0))
    size = F.greatest(F.least(F.size(item) - skip, F.size(doc) - diag - skip), F.lit(0))
    return F.size(F.filter(F.zip_with(F.slice(item, skip + 1, size), F.slice(doc, diag + skip + 1, size), lambda a, b: a == b), lambda x: x))


def _densest(places: Column) -> Column:
    """The most of ``places`` in WINDOW places in a row."""
    return F.array_max(F.transform(places, lambda i: F.size(F.filter(places, lambda j: (j >= i) & (j < i + WINDOW)))))


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Pairs (doc_id, item_id) of a document and an item it leaks, with item_tokens, matches, doc_start and similarity.

    One row a pair: the place with most matching tokens, the first of equal ones (doc_start
    is negative if the item's head is cut off). An item of SEEDED tokens or more is leaked
    if SHARE of some WINDOW of its places is in place, around a hit; a shorter one if it
    stands in the document word for word, which a benchmark of single words will do often.
    Null and empty texts have no tokens and no pair; rows without an item_id aren't items,
    and all documents without an id count as one, whose doc_id is null; repeated ids count
    as one document or item; empty tables give an empty result; other columns are ignored.
    """
    items = benchmark.select("item_id", tokens_of(text_of()).alias("item")).where((F.size("item") > 0) & F.col("item_id").isNotNull())
    bound = items.agg(F.sum(F.size("item")).alias("t"), F.collect_set(F.when(F.size("item") < SEEDED, F.size("item"))).alias("short")).first()
    total, always, n = bound["t"] or 0, F.lit(True), F.col("n")
    whole = {"1" * k: k for k in sorted(bound["short"])}
    # a run of ones may be a mask for longer items and a short item as well, so short items are told apart by their condition
    seeds = _seeds(items.where(F.size("item") >= SEEDED), "item", dict.fromkeys(MASKS, always), "item_id")
    if whole:
        seeds = seeds.union(_seeds(items.where(F.size("item") < SEEDED), "item", {m: (n == k) & (F.col("pos") == 0) for m, k in whole.items()}, "item_id"))
    seeds = seeds.select("key", "item_id", F.col("pos").alias("item_pos"))
    masks = dict.fromkeys([*MASKS, *whole], always)
    small = total * len(MASKS) <= broadcast_seeds and total <= BROADCAST_TOKENS
    read = docs.select("doc_id", tokens_of(text_of()).alias("doc"))
    diag = (F.col("pos") - F.col("item_pos")).alias("diag")
    if small:
        hits = _seeds(read, "doc", masks, "doc_id", "doc").join(F.broadcast(seeds), "key").select("doc_id", "doc", "item_id", diag)
        laid = hits.join(F.broadcast(items), "item_id")
    else:
        # as good as any number of items: only ids, places and keys are shuffled, then the texts of candidate pairs
        hits = _seeds(read, "doc", masks, "doc_id").join(seeds, "key").select("doc_id", "item_id", diag).distinct()
        texts = read.select(F.col("doc_id").alias("own_id"), "doc")
        laid = hits.join(items, "item_id").join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")))
    over = (F.col("diag"), F.col("item"), F.col("doc"))
    wanted = F.when(F.size("item") < SEEDED, F.size("item")).otherwise(F.ceil(SHARE * F.least(F.size("item"), F.lit(WINDOW))))
    # with so few places amiss every window has enough; only between that and too few is there anything to look for
    dense = (F.size("item") <= WINDOW) | (F.size("item") - _matches(*over) <= WINDOW - wanted) | (_densest(_places(*over)) >= wanted)
    found = laid.where(_matches(*over) >= wanted).where(dense).select("doc_id", "item_id", F.size("item").alias("item_tokens"), F.col("diag").alias("doc_start"), _matches(*over).alias("matches"))
    best = found.groupBy("doc_id", "item_id", "item_tokens").agg(F.max(F.struct("matches", (-F.col("doc_start")).alias("back"))).alias("b"))
    one = best.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("b.matches").alias("matches"), "item_tokens", F.col("b.back").alias("back"))).alias("b"))
    return one.select(
        "doc_id", "item_id",
        F.col("b.item_tokens").cast("long").alias("item_tokens"), F.col("b.matches").cast("long").alias("matches"), (-F.col("b.back")).cast("long").alias("doc_start"),
        (F.col("b.matches") / F.col("b.item_tokens")).alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns as they were; rows without an id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
