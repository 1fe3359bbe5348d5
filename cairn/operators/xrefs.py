"""References to addresses and strings, and which functions use what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.addresses import ADDRESS, offset_to_va
from cairn.operators.asof import asof_join
from cairn.operators.grouping import capped, top_per_group

#: Functions listed for one algorithm.
USERS = 12


def annotate(strings: DataFrame, refs: DataFrame, by: list[str], va: str = "va") -> DataFrame:
    """``strings`` with ``xrefs``: how many references go to their start; 0 where the address is null or none does."""
    counts = refs.groupBy(*by, F.col("target").alias(va)).agg(F.count(F.lit(1)).alias("xrefs"))
    return strings.join(counts, [*by, va], "left").withColumn("xrefs", F.coalesce("xrefs", F.lit(0).cast("long")))


def to_targets(targets: DataFrame, index: DataFrame, held: DataFrame, sections: DataFrame, by: list[str], most: int = 256, width: float | None = None) -> DataFrame:
    """Everything that refers to each target: ``target, via, kind, site, aligned, total, clipped``.

    ``index``: the code index; ``held``: ``target, offset, size`` of stored
    pointers.  Of every target and way the first ``most`` sites are shown,
    with the exact ``total``.
    """
    asked = targets.select(*by, "target").distinct()
    none = F.lit(None).cast("boolean")
    code = index.where("kind = 'reference'").join(asked, [*by, "target"]).select(*by, "target", F.lit("code_operand").alias("via"), F.col("detail").alias("kind"), "site", none.alias("aligned"))
    calls = index.where("kind = 'call'").join(asked, [*by, "target"]).select(*by, "target", F.lit("direct_call").alias("via"), F.lit("call").alias("kind"), "site", none.alias("aligned"))
    placed = offset_to_va(held, sections.select(*by, "va", "fileoff", "filesize"), by, width=width).where(F.col("va").isNotNull())
    data = placed.select(*by, "target", F.lit("data_scan").alias("via"), F.concat(F.lit("ptr"), (F.col("size") * 8).cast("string")).alias("kind"), F.col("va").alias("site"), (F.col("va") % F.col("size") == 0).alias("aligned"))
    rows = capped(code.unionByName(calls).unionByName(data), [*by, "target", "via"], ["site", "kind"], most)
    return rows.withColumn("clipped", F.col("overflow") > 0).drop("overflow", "seq")


def algorithm_users(hits: DataFrame, index: DataFrame, starts: DataFrame, sections: DataFrame, by: list[str], k: int = USERS, width: float | None = None) -> DataFrame:
    """Per algorithm the ``k`` functions with most references to its markers: ``name, function, refs, rank``.

    A marker inside an instruction counts where the instruction is; one in the
    file's bytes by the references to its address.
    """
    inline = hits.where("kind = 'immediate'").select(*by, "name", F.col("place").cast(ADDRESS).alias("va"))
    stored = hits.where("kind <> 'immediate'").select(*by, "name", F.col("place").cast("long").alias("offset"))
    placed = offset_to_va(stored, sections.select(*by, "va", "fileoff", "filesize"), by, width=width).where(F.col("va").isNotNull())
    refs = index.where("kind = 'reference'").select(*by, F.col("target").alias("va"), "site")
    sites = placed.select(*by, "name", "va").distinct().join(refs, [*by, "va"]).select(*by, "name", F.col("site").alias("va"))
    spans = starts.select(*by, "va", F.col("va").alias("function"))
    owned = asof_join(inline.unionByName(sites), spans, by, "va", ["function"], width).where(F.col("function").isNotNull())
    counted = owned.groupBy(*by, "name", "function").agg(F.count(F.lit(1)).alias("refs"))
    return top_per_group(counted, [*by, "name"], [F.desc("refs"), F.col("function")], k)
