"""Joins and orderings with defined winners: known names, first matches, as-of values, parents, first-seen rows, shares of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_known(rows: DataFrame, known: DataFrame, names: str, name: str = "name", key: str = "_row") -> DataFrame:
    """``rows`` with the array column ``names`` cut down to names that ``known`` has, in order; rows may end up with none."""
    numbered = rows.withColumn(key, F.monotonically_increasing_id())
    found = numbered.select(key, F.posexplode(names).alias("_pos", name)).join(known.select(name).distinct(), name, "left_semi")
    kept = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", name))), lambda x: x[name]).alias("_kept"))
    out = numbered.join(kept, key, "left").withColumn(names, F.coalesce("_kept", F.array().cast("array<string>")))
    return out.select(*rows.columns)


def first_known(pairs: DataFrame, key: str, targets: str, rows: DataFrame, name: str = "name") -> DataFrame:
    """``key`` and the columns of ``rows`` for each pair's first target that ``rows`` has; pairs without one are left out."""
    at = pairs.select(key, F.posexplode(targets).alias("_pos", name)).join(rows, name)
    best = at.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "_pos").alias("_r"))
    return best.select(key, "_r.*")


def last_wins(rows: DataFrame, name: str = "name", *order: str) -> DataFrame:
    """One row a name: the last in ``order``."""
    return rows.groupBy(name).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def first_seen(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each value of ``keys``: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` of the same ``by`` at or before ``at``; null if there is none.

    One sort over the union of both sides, no pair of rows is ever made. Several right rows
    at one time: the greatest value.
    """
    rows = left.select(F.lit(1).alias("_side"), by, at, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    marks = right.groupBy(by, at).agg(F.max(value).alias("_v")).select(F.lit(0).alias("_side"), by, at, F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), "_v")
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("_at", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_l.*", F.col("_at").alias(value))


def carried(rows: DataFrame, by: list[str], order: list[str], when: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the nearest earlier row for which ``when`` holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def next_match(rows: DataFrame, by: list[str], order: list[str], when: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the nearest later row for which ``when`` holds."""
    # from the end backwards: a growing frame keeps one value, a shrinking one would be gone over again for every row
    w = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(w))


def contained(points: DataFrame, spans: DataFrame, by: str, point: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and a span of the same ``by`` with start <= point < end; the key makes it an equi-join."""
    return points.join(spans, by).where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end)))


def siblings(rows: DataFrame, group: str, name: str = "name") -> DataFrame:
    """(name, sibling): for each name the least other name of its group; names alone in their group are left out.

    The two least names of a group answer for all its members, so no pair is ever made.
    """
    first = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(name).alias("_first"))
    second = rows.join(first, group).where(F.col(name) != F.col("_first")).groupBy(group).agg(F.min(name).alias("_second"))
    other = rows.join(first, group).join(second, group, "left").withColumn("sibling", F.when(F.col(name) != F.col("_first"), F.col("_first")).otherwise(F.col("_second")))
    return other.where("sibling is not null").select(name, "sibling")


def alternate(rows: DataFrame, key: str, folds: int = 2) -> DataFrame:
    """(key, fold): distinct keys dealt in turn in their order."""
    keys = rows.select(key).distinct()
    return keys.select(key, F.pmod(F.dense_rank().over(Window.orderBy(key)) - 1, F.lit(folds)).alias("fold"))


def tail(name: Column) -> Column:
    """The last dotted part; null for a name without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1))
