"""Statistics of a text as Spark column expressions; null counts as the empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body's lambdas name it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first time included.

    Windows are compared by their 64-bit hash. Their hashes are sorted with their places;
    equal neighbours are the repeated ones, and their places in text order give the words
    covered. The sort is left out where all hashes differ.
    """
    n = F.size(words)
    hashes = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(p):
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(_bind(placed, places), total))

    return _bind(hashes, covered)


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_upper, n_bang, n_stops, n_punctuation."""
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    d = docs.select(*keep, text_of().alias("_text")).select("*", words_of(t).alias("_words"), lines.alias("_lines"))
    w, ls = F.col("_words"), F.col("_lines")
    out = d.select(
        *keep,
        F.size(w).alias("n_words"),
        F.length(F.translate(t, SPACE, "")).alias("word_chars"),
        count_of(t, SYMBOLS).alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(ls).alias("n_lines"),
        F.size(F.array_distinct(w)).alias("n_distinct"),
        count_of(t, UPPER).alias("n_upper"),
        count_of(t, "!").alias("n_bang"),
        count_of(t, ".?").alias("n_stops"),
        count_of(t, PUNCTUATION).alias("n_punctuation"),
    )
    return out.select(*keep, *[F.col(c).cast("long").alias(c) for c in out.columns if c not in keep])
