"""Additive twins: declarations that an attribute generates and no source states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.additive import additive_name, additive_words, explicit_additive_name, explicit_target, has_attribute
from ..functions.lexical import head_words


def proposed(rows: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Rows with the attribute, with kind_ (explicit, inferred), new (null: untranslatable) and checked.

    checked is validated if ``truth`` (name, module) covers the row's module and has the
    new name, dropped if it covers the module only, else unvalidated. Two key joins, since
    coverage goes by module and membership by name.
    """
    marked = rows.where(has_attribute(F.col("attrs"))).withColumn("_explicit", explicit_target(F.col("attrs")))
    new = F.when(F.col("_explicit").isNotNull(), explicit_additive_name("name", "_explicit")).otherwise(additive_name("name"))
    named = marked.withColumns({"kind_": F.when(F.col("_explicit").isNotNull(), "explicit").otherwise("inferred"), "new": F.nullif(new, F.lit(""))})
    if truth is None:
        return named.withColumn("checked", F.lit("unvalidated")).drop("_explicit")
    modules = truth.select("module").distinct().withColumn("_covered", F.lit(True))
    names = truth.select(F.col("name").alias("new")).distinct().withColumn("_known", F.lit(True))
    j = named.join(modules, "module", "left").join(names, "new", "left")
    checked = F.when(F.col("_covered").isNull(), "unvalidated").when(F.col("_known"), "validated").otherwise("dropped")
    return j.withColumn("checked", checked).drop("_explicit", "_covered", "_known")


def expand(rows: DataFrame, truth: DataFrame | None = None, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` and their twins with typ_tokens (null for rows that were there), and counts (outcome, n).

    A twin isn't made where its name exists already or an earlier row in ``order`` has made
    it; names that the truth contradicts are dropped, each row counting.
    """
    order = order or tuple(c for c in ("path", "module", "ord", "line", "name") if c in rows.columns)
    all_ = proposed(rows, truth)
    stay = all_.where("new is not null").join(rows.select(F.col("name").alias("new")).distinct(), "new", "left_anti")
    first = Window.partitionBy("new").orderBy(*order)
    kept = stay.where("checked <> 'dropped'").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    twins = kept.withColumns({
        "typ_tokens": additive_words(head_words(F.coalesce("head", F.lit("")))), "name": F.col("new"), "head": F.lit(""),
        "provenance": F.concat_ws(":", F.lit("to_additive"), "kind_", "checked"),
    })
    before = rows.withColumn("typ_tokens", F.lit(None).cast("array<string>")) if "typ_tokens" not in rows.columns else rows
    outcome = lambda d, what: d.groupBy(F.concat_ws(":", "kind_", what).alias("outcome")).agg(F.count("*").alias("n"))
    counts = outcome(all_.where("new is null"), F.lit("untranslatable")).union(outcome(stay.where("checked = 'dropped'"), F.col("checked"))).union(outcome(kept, F.col("checked")))
    return before.unionByName(twins.select(*before.columns)), counts
