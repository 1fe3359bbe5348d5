"""As-of joins: each left row gets the latest right row at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], width: float | None = None) -> DataFrame:
    """``left`` with the columns ``take`` (null where none) of the last right row with ``right.on <= left.on``.

    Both sides have the columns ``by`` and ``on``; among right rows with equal
    keys the greatest struct of ``take`` counts.  A null key or a null ``on`` never
    matches, and left rows are all kept.  One sort per key: rows of both sides are put
    together and the last non-null right row is carried along.

    ``width`` splits hot keys: each key is cut into ranges of that many units
    of ``on``; a range's window starts with the last right row of the ranges
    before it, which one aggregate and a window over ranges (not rows) give.
    """
    kept = [c for c in left.columns if c not in by and c != on]
    # one right row for each key and instant, so that no window holds ties
    present = F.col(on).isNotNull()
    for c in by:
        present = present & F.col(c).isNotNull()
    best = right.where(present).groupBy(*by, on).agg(F.max(F.struct(*take)).alias("__take"))
    both = left.select(*by, on, F.lit(1).alias("__side"), F.struct(F.lit(1).alias("__one"), *kept).alias("__left"), F.lit(None).cast(best.schema["__take"].dataType).alias("__take"))
    null_left = F.lit(None).cast(both.schema["__left"].dataType)
    both = both.unionByName(best.select(*by, on, F.lit(0).alias("__side"), null_left.alias("__left"), "__take"))
    keys = list(by)
    if width is not None:
        stamp = both.schema[on].dataType.typeName().startswith("timestamp")
        both = both.withColumn("__range", _range(F.col(on).cast("timestamp") if stamp else F.col(on), width))
        ends = both.where("__side = 0").groupBy(*by, "__range").agg(F.max_by("__take", on).alias("__end"))
        places = both.select(*by, "__range").distinct().join(ends, [*by, "__range"], "left")
        earlier = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        both = both.join(places.select(*by, "__range", earlier.alias("__before")), [*by, "__range"], "left")
        keys.append("__range")
    run = Window.partitionBy(*keys).orderBy(F.col(on).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__take", ignorenulls=True).over(run)
    if width is not None:
        found = F.coalesce(found, F.when(F.col(on).isNotNull(), F.col("__before")))
    rows = both.withColumn("__found", found).where("__side = 1")
    return rows.select(*by, on, *[F.col("__left")[c].alias(c) for c in kept], *[F.col("__found")[c].alias(c) for c in take])


def _range(on: Column, width: float) -> Column:
    return F.floor(on.cast("double") / F.lit(float(width))).cast("long")


def next_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], width: float | None = None) -> DataFrame:
    """``left`` with ``take`` of the first right row with ``right.on >= left.on`` (numbers): the as-of join turned around."""
    turned = right.withColumn("__on", -F.col(on)).drop(on) if on not in take else right.withColumn("__on", -F.col(on))
    return asof_join(left.withColumn("__on", -F.col(on)), turned, by, "__on", take, width).drop("__on")


def extent_of(points: DataFrame, starts: DataFrame, by: list[str], point: str, start: str, cap, width: float | None = None) -> DataFrame:
    """``points`` with ``extent_start, extent_end`` of the function they are in.

    A point before the first start has an extent of its own, from itself on.
    """
    spans = extents(starts.select(*by, start).distinct(), by, start, cap)
    spans = spans.select(*by, F.col(start).alias(point), F.col(start).alias("extent_start"), "extent_end")
    got = asof_join(points, spans, by, point, ["extent_start", "extent_end"], width)
    return got.withColumns({"extent_start": F.coalesce("extent_start", F.col(point)), "extent_end": F.coalesce("extent_end", F.col(point) + cap)})


def extents(starts: DataFrame, by: list[str], start: str, cap) -> DataFrame:
    """``starts`` with ``extent_end``: the next start of the key, at most ``start + cap``."""
    limit = F.col(start) + cap
    return starts.withColumn("extent_end", F.least(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), limit)).withColumn("extent_end", F.coalesce("extent_end", limit))
