"""Grouped collections, top lists and roll-ups with total orders and exact overflow counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(df: DataFrame, by: list[str], order: list[Column | str], cap: int) -> DataFrame:
    """The first ``cap`` rows of every group in ``order``, with ``seq`` (from 1), the group's ``total`` and its ``overflow``.

    The cut happens before the shuffle (a limit per group and task), so a hot
    group sends at most ``cap`` rows from each task; the exact total comes from
    a partial count.
    """
    rows = df.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("seq") <= cap)
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by]
    joined = rows.join(totals.select(*[F.col(c).alias(f"__{c}") for c in by], "total"), same).drop(*[f"__{c}" for c in by])
    return joined.withColumn("overflow", F.greatest(F.col("total") - cap, F.lit(0)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group in ``order``."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def frequency_top(df: DataFrame, value: str, k: int, first_seen: str | None = None, out: str = "n") -> DataFrame:
    """The ``k`` most frequent values; ties by first place (``first_seen``) or by value."""
    tie = [F.min(first_seen).alias("__first")] if first_seen else []
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias(out), *tie)
    return counted.orderBy(F.desc(out), F.col("__first") if first_seen else F.col(value)).limit(k).drop("__first")


def histogram(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def duplicates(df: DataFrame, name: str, source: str) -> DataFrame:
    """Names defined in more than one distinct source: ``copies`` (all rows) and the sorted ``sources``."""
    pairs = df.groupBy(name, source).agg(F.count(F.lit(1)).alias("__n"))
    found = pairs.groupBy(name).agg(F.sum("__n").alias("copies"), F.array_sort(F.collect_set(source)).alias("sources"))
    return found.where(F.size("sources") > 1)


def first_definition(df: DataFrame, name: list[str], order: list[Column | str]) -> DataFrame:
    """One row per name: the first in ``order`` (the earlier source overrides the later)."""
    return top_per_group(df, name, order, 1, "__rank").drop("__rank")


def coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """For every array column, in how many rows it has elements."""
    return df.agg(*[F.count_if(F.size(c) > 0).alias(c) for c in features])


def worst(df: DataFrame, by: list[str], rank: Column, out: str = "reliability") -> DataFrame:
    """The greatest rank of every group."""
    return df.groupBy(*by).agg(F.max(rank).alias(out))
