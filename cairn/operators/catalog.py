"""Marker catalogues: which named things do the markers found in a table identify, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.grouping import top_per_group


def hits(found: DataFrame, markers: DataFrame) -> DataFrame:
    """Occurrences (``value`` and any place columns) with the catalogue rows (``name, label, value``) they mark.

    A value may mark several names; the catalogue is a small dimension table.
    """
    return found.join(markers, "value")


def verdicts(hit: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per identified or suspected name.

    ``catalogue``: ``name, min_distinct, discriminators`` (how many it has).
    Identified: enough distinct markers and, if the name has discriminators, at
    least one of them; else a lead with the reason ``too_few`` or ``no_discriminator``.
    Confident ones first, then by distinct markers, then by name.
    """
    per = hit.groupBy("name").agg(F.countDistinct("label").alias("distinct_markers"), F.count(F.lit(1)).alias("hits"), F.bool_or("is_discriminator").alias("discriminated"))
    got = per.join(catalogue, "name")
    enough = F.col("distinct_markers") >= F.col("min_distinct")
    told = (F.col("discriminators") == 0) | F.col("discriminated")
    return got.select(
        "name",
        "distinct_markers",
        "hits",
        "discriminated",
        F.when(enough & told, "identified").otherwise("lead").alias("verdict"),
        F.when(enough & told, "").when(~enough, "too_few").otherwise("no_discriminator").alias("reason"),
    ).orderBy(F.col("verdict") != "identified", F.desc("distinct_markers"), "name")


def attribution(hit: DataFrame, place: str, k: int = 12) -> DataFrame:
    """Per name the ``k`` places with most hits."""
    counted = hit.groupBy("name", place).agg(F.count(F.lit(1)).alias("refs"))
    return top_per_group(counted, ["name"], [F.desc("refs"), F.col(place)], k)


def encodings(markers: DataFrame, value: str = "value", bits: str = "width") -> DataFrame:
    """Byte patterns (hexadecimal) of numeric markers from 0x10000 on: both byte orders, and 32-bit values in 64-bit slots."""
    big = markers.where(F.col(value) >= 0x10000)
    text = F.lower(F.lpad(F.hex(F.col(value).cast("long")), F.when(F.col(bits) == 64, 16).otherwise(8), "0"))
    n = F.length(text) / 2
    little = F.array_join(F.transform(F.sequence(n.cast("int"), F.lit(1), F.lit(-1)), lambda i: F.substring(text, i * 2 - 1, F.lit(2))), "")
    forms = F.array(F.struct(F.lit("big").alias("order"), text.alias("pattern")), F.struct(F.lit("little").alias("order"), little.alias("pattern")))
    wide = F.when(F.col(bits) == 32, F.array(F.struct(F.lit("little64").alias("order"), F.concat(little, F.lit("00000000")).alias("pattern")))).otherwise(F.array().cast("array<struct<order:string,pattern:string>>"))
    return big.withColumn("form", F.explode(F.concat(forms, wide))).select(*markers.columns, "form.order", "form.pattern")
