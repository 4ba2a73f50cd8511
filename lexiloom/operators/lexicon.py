"""The lexicon of a library of declarations: words, document frequencies, postings, lengths and a learned translation table.

All tables are in long form, one row a word or a pair. Rows of declarations need decl_id
and the word arrays tokens, mod_tokens and typ_tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import draw, head_words, identifier_words, module_words, prose_words


def with_words(declarations: DataFrame) -> DataFrame:
    """Declarations with tokens, mod_tokens and, where they have none yet, typ_tokens."""
    own = head_words(F.coalesce("head", F.lit("")), F.col("provenance").eqNullSafe("elaborated"))
    types = F.coalesce("typ_tokens", own) if "typ_tokens" in declarations.columns else own
    return declarations.withColumns({"tokens": identifier_words(F.col("name")), "mod_tokens": module_words(F.coalesce("module", F.lit(""))), "typ_tokens": types})


def document_frequency(rows: DataFrame, *fields: str) -> DataFrame:
    """(token, df): rows that hold a token in any of the array columns ``fields``."""
    words = F.array_distinct(F.concat(*[F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields]))
    return rows.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def inverse_frequency(df: DataFrame, rows: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + N / (1 + df)), N being the number of rows."""
    n = rows.agg(F.count("*").alias("n"))  # one row
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def postings(rows: DataFrame) -> DataFrame:
    """(field, token, decl_id), each once. What the name says isn't filed under module or type again."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in ("name", "mod", "typ")])
    return posted_words(rows).select("decl_id", F.explode(fields).alias("f")).select(F.col("f.field").alias("field"), F.explode("f.words").alias("token"), "decl_id")


def posted_words(rows: DataFrame) -> DataFrame:
    """(decl_id, name, mod, typ): the words that :func:`postings` files, as arrays."""
    return rows.select("decl_id", F.array_distinct("tokens").alias("name"), F.array_except("mod_tokens", "tokens").alias("mod"), F.array_except("typ_tokens", "tokens").alias("typ"))


def posting_sizes(posted: DataFrame) -> DataFrame:
    """(token, n_name, n_mod, n_typ)."""
    return posted.groupBy("token").agg(*[F.count_if(F.col("field") == f).alias(f"n_{f}") for f in ("name", "mod", "typ")])


def length_norms(rows: DataFrame, idf: DataFrame, pivot: float = 0.75) -> DataFrame:
    """(decl_id, len, lennorm): len is the idf of the distinct name words (1 if that is 0), lennorm its pivoted ratio to the mean."""
    words = rows.select("decl_id", F.explode(F.array_distinct("tokens")).alias("token")).join(idf.select("token", "idf"), "token", "left")
    sums = rows.select("decl_id").distinct().join(words.groupBy("decl_id").agg(F.sum("idf").alias("s")), "decl_id", "left")
    lens = sums.select("decl_id", F.when(F.coalesce("s", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("s")).alias("len"))
    mean = lens.agg(F.avg("len").alias("mean"))
    return lens.crossJoin(F.broadcast(mean)).select("decl_id", "len", ((1 - pivot) + pivot * F.col("len") / F.col("mean")).alias("lennorm"))


@dataclass(frozen=True)
class Support:
    """What a learned pair needs, and how much it is shrunk and kept."""

    pairs: int = 5
    words: int = 4
    shrink: float = 25.0
    keep: int = 12


ENGLISH, FORMULAS = Support(), Support(pairs=3, words=3, shrink=8.0, keep=10)


def translation_table(rows: DataFrame, words: Column, tokens: Column, support: Support = ENGLISH) -> DataFrame:
    """(word, token, weight, rk) learned from co-occurrence in rows of the sets ``words`` and ``tokens``.

    weight is the pointwise mutual information, shrunk by c / (c + shrink) and divided by
    the word's best. The number of all pair events is a sum of products, so words and
    tokens too rare to survive go before any pair is made, without changing a result. Ties
    go to the token first in the alphabet.
    """
    sets = rows.select(F.array_distinct(words).alias("ws"), F.array_distinct(tokens).alias("ts")).where((F.size("ws") > 0) & (F.size("ts") > 0))
    total = sets.agg(F.sum(F.size("ws").cast("long") * F.size("ts")).alias("total"))
    least = max(support.words, support.pairs)
    # a pair seen ``pairs`` times has a word and a token seen as often
    cw = sets.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("cw")).where(F.col("cw") >= least)
    ct = sets.select(F.explode("ts").alias("token")).groupBy("token").agg(F.count("*").alias("ct")).where(F.col("ct") >= least)
    events = sets.select(F.explode("ws").alias("word"), "ts").join(cw.select("word"), "word", "left_semi").select("word", F.explode("ts").alias("token"))
    pairs = events.groupBy("word", "token").agg(F.count("*").alias("c")).where(F.col("c") >= support.pairs)
    joined = pairs.join(cw, "word").join(ct, "token").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("c") * F.col("total") / (F.col("cw") * F.col("ct")) + 1e-12)
    raw = joined.withColumn("pmi", pmi).where("pmi > 0").select("word", "token", (F.col("pmi") * F.col("c") / (F.col("c") + support.shrink)).alias("raw"))
    best = Window.partitionBy("word").orderBy(F.desc(F.round("raw", 9)), "token")
    top = raw.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= support.keep)
    return top.select("word", "token", (F.col("raw") / F.max("raw").over(Window.partitionBy("word"))).alias("weight"), "rk")


@dataclass(frozen=True)
class Lexicon:
    """The tables that a query needs. ``idf`` has the sizes of a token's postings as well."""

    rows: DataFrame
    idf: DataFrame
    postings: DataFrame
    norms: DataFrame
    translations: DataFrame


def split(rows: DataFrame, share: float, salt: str) -> Column:
    """Whether a row falls into a reproducible share of all rows, by the hash of its id."""
    return draw(salt, F.col("decl_id")) % 1_000_000 < int(share * 1_000_000)


def build(rows: DataFrame, pivot: float = 0.75, holdout: float = 0.0, unlearned: float = 0.0) -> tuple[Lexicon, DataFrame, DataFrame]:
    """The lexicon of rows with words; the held-out documented rows, which it leaves out; and those it holds but doesn't learn from.

    Shares are of documented rows, by hash. Tables stay lazy: write them with
    :func:`lexiloom.sources.store.save`, or persist them, before using them more than once.
    """
    documented = F.coalesce("doc", F.lit("")) != ""
    out = documented & split(rows, holdout, "holdout")
    held, kept = rows.where(out), rows.where(~out)
    blind = documented & split(kept, unlearned, "unlearned")
    df = document_frequency(kept, "tokens", "mod_tokens", "typ_tokens")
    posted = postings(kept)
    idf = inverse_frequency(df, kept).join(posting_sizes(posted), "token", "left").fillna(0, ["n_name", "n_mod", "n_typ"])
    table = translation_table(kept.where(documented & ~blind), prose_words(F.col("doc")), F.col("tokens"))
    return Lexicon(kept, idf, posted, length_norms(kept, idf, pivot), table), held, kept.where(blind)


def provenance_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("provenance", F.lit("source")).alias("provenance")).agg(F.count("*").alias("n"))
