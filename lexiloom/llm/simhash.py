"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits in two halves of 32. Two fingerprints at 4 or fewer differing
bits have a half at 2 or fewer, so both reach a common value by flipping at most one bit
of that half each: every fingerprint is filed under the 33 values around each of its
halves, and fingerprints that meet in a bucket are compared over all 64 bits.

A bucket of more than ``bucket`` distinct fingerprints isn't paired up. Its fingerprints
are filed once more under every 64-bit value at 2 or fewer flips: two that are linked
always meet there, and all that meet there are within 4 bits, so each bucket becomes a
star around its smallest member. Nothing is lost or capped on either way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, from_texts, join_hot, materialise

BITS, HALF, RADIUS, BUCKET = 64, 32, 4, 64


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    k = min(width, len(words))
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long. A null or empty text, or one of white space, has 0."""

    def signed(text: str | None) -> tuple[int]:
        x = fingerprint(text)
        return (x - (1 << 64) if x >> 63 else x,)

    return from_texts(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], {"fp": pa.int64()}, lambda: signed)


def _halves(fp: Column) -> Column:
    """The 66 bucket keys: which half, and its value with at most one bit flipped."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(HALF)])
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(fp, HALF)
    return F.concat(F.transform(masks, lambda m: low.bitwiseXOR(m)), F.transform(masks, lambda m: high.bitwiseXOR(m) + F.lit(1 << HALF)))


def _ball() -> list[int]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(1 << i for i in bits)) for n in range(3) for bits in combinations(range(BITS), n)]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that join exactly the fingerprints of each component."""
    filed = fps.select("fp", F.explode(_halves(F.col("fp"))).alias("key"))
    met = materialise(filed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "met")
    small = met.where(F.col("n") <= bucket)
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .where("a < b")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
        .select("a", "b")
    )
    ball = F.array(*[F.lit(m).cast("long") for m in _ball()])
    near = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(ball).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    stars = near.withColumn("b", F.min("fp").over(Window.partitionBy("key"))).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def components(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts share fingerprint 0 and are linked like any other; repeated ids
    give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    group = connected_components(links(distinct.select("fp"), bucket))
    grouped = distinct.join(group, distinct["fp"] == group["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    of = materialise(grouped, "members")
    least = materialise(of.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("fps")), "components")
    named = materialise(join_hot(of.select("fp", "n", "component"), least, ["component"], "fps").select("fp", "n", "component_id"), "named")
    return join_hot(fps, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Keep the document with the smallest id of each component, all columns as they were.

    Rows without an id stay. Rows of one id stay or go together: they go if any of their
    texts is a near copy of a document with a smaller id.
    """
    drop = components(docs).groupBy("doc_id").agg(F.bool_and(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti")
