"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

The rows of a source are cut into blocks in ascending id order.  With whole
weights ``w`` of sum ``W``, block ``b`` (from 0) of a source is released at slot
``floor(b * W / w)`` and due by slot ``ceil((b + 1) * W / w)``; earliest deadline
first over these windows keeps every source less than one block away from its
target at every slot.

Slots are worked out in independent periods, one row each.  At the limits of a
period the blocks placed so far are the targets ``t * w / W`` rounded by largest
remainders, so nothing drifts from period to period; inside, the period's blocks
go to its slots by earliest deadline among the released ones.  All of it is in
whole numbers.  When a source runs out, its slots stay empty and the others go
on in their proportions; the last slot is thus about the greatest
``blocks * W / w``.  All rows are kept.

One row per source reaches the driver; rows of the table do not.

Defined cases: a null source is a source of its own; rows with equal id and
source share one place (``n`` counts them); null ids come first; sources of
target weight 0 follow behind all others, one after another; an empty table gives
no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import isfinite, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut

BLOCK_ROWS = 16
#: Slots of one period, and at least so many for each source.
PERIOD, PER_SOURCE = 256, 4
#: Default targets: whole weights ``floor(SCALE * sqrt(rows))``.
SCALE = 16
RANGE_ROWS, MOST_RANGES = 200_000, 4096


def whole_weights(weights: list) -> list[int]:
    """Weights as whole numbers in the same proportions (to 1 in 2**20 of the greatest where they are not rational with small terms)."""
    if any(not isfinite(w) or w < 0 for w in weights):
        raise ValueError("weights are finite and not negative")
    exact = [Fraction(w).limit_denominator(10**6) for w in weights]
    scale = lcm(*[x.denominator for x in exact]) if exact else 1
    if scale > 1 << 20:
        scale = (1 << 20) / max(weights)
        return [max(1, round(w * scale)) if w else 0 for w in weights]
    return [int(x * scale) for x in exact]


def schedule(spark, weights: list[int], blocks: list[int], period: int = PERIOD) -> DataFrame:
    """``rank, block, release, deadline, slot`` of every block; ``rank``: place in the lists (weights above 0)."""
    n, total = len(weights), sum(weights)
    period = max(period, PER_SOURCE * n)
    last = max((-(-b * total // w) for b, w in zip(blocks, weights)), default=0)
    lists = {name: "array(" + ", ".join(f"{x}L" for x in values) + ")" for name, values in (("w", weights), ("m", blocks))}

    def placed(t):
        """Blocks of every source before slot ``t``: largest remainders first, ties to the lower rank."""
        product = f"CAST({t} AS DECIMAL(19,0)) * CAST(x AS DECIMAL(19,0))"
        return f"""transform(array(struct(transform(w, x -> {product} DIV {total}L) AS low, transform(w, (x, i) -> struct(-CAST({product} % {total}L AS BIGINT) AS rest, i)) AS rest)),
            y -> transform(array(struct(y.low AS low, y.rest AS rest, array_sort(y.rest) AS sorted, CAST({t} - aggregate(y.low, 0L, (a, x) -> a + x) AS INT) AS more)),
            z -> transform(z.low, (x, i) -> x + IF(z.more > 0 AND z.rest[i] <= z.sorted[z.more - 1], 1L, 0L)))[0])[0]"""

    release = f"CAST(b AS DECIMAL(19,0)) * {total}L DIV w[i]"
    deadline = f"(CAST(b + 1 AS DECIMAL(19,0)) * {total}L + w[i] - 1) DIV w[i]"
    jobs = f"""array_sort(flatten(transform(a, (first, i) -> IF(first < least(z[i], m[i]),
        transform(sequence(first, least(z[i], m[i]) - 1), b -> struct({deadline} AS deadline, i, b, {release} AS release)),
        CAST(array() AS ARRAY<STRUCT<deadline: BIGINT, i: INT, b: BIGINT, release: BIGINT>>)))))"""
    # the state: jobs left, in the order of their deadlines, and the jobs placed
    soonest = "array_min(transform(v.left, x -> struct(x.release, x.deadline, x.i, x.b)))"
    pick = f"""CASE WHEN exists(v.left, x -> x.release <= id * {period} + s) THEN filter(v.left, x -> x.release <= id * {period} + s)[0]
        WHEN size(v.left) > 0 AND {period} - s <= size(v.left) THEN transform(array({soonest}), x -> struct(x.deadline AS deadline, x.i AS i, x.b AS b, x.release AS release))[0] END"""
    step = f"""transform(array({pick}), p -> IF(p IS NULL, v, struct(filter(v.left, x -> NOT (x.i = p.i AND x.b = p.b)) AS left,
        concat(v.out, array(struct(p.i AS rank, p.b AS block, p.release AS release, p.deadline AS deadline, CAST(id * {period} + s AS BIGINT) AS slot))) AS out)))[0]"""
    none = "CAST(array() AS ARRAY<STRUCT<rank: INT, block: BIGINT, release: BIGINT, deadline: BIGINT, slot: BIGINT>>)"
    rows = spark.range(-(-last // period)).selectExpr("id", f"{lists['w']} AS w", f"{lists['m']} AS m")
    rows = rows.selectExpr("id", "w", "m", f"{placed(f'(id * {period})')} AS a", f"{placed(f'((id + 1) * {period})')} AS z")
    rows = rows.selectExpr("id", f"{jobs} AS jobs").where("size(jobs) > 0")
    return rows.selectExpr(f"inline(aggregate(sequence(0, {period - 1}), struct(jobs AS left, {none} AS out), (v, s) -> {step}, v -> v.out))")


def places(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """``id, source, n, block, release, deadline, slot, place`` for every distinct id and source.

    The mixed order is by ``slot, place``; ``place`` counts rows of a block.
    ``weights`` maps sources to target weights (default: in proportion to the
    square root of their rows, in whole numbers).
    """
    spark = docs.sparkSession
    keys = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source")).groupBy("id", "source").agg(F.count(F.lit(1)).alias("n"))
    keys = cut(keys, "mix-keys")
    per = keys.groupBy("source").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    per = per.withColumn("target", F.floor(F.sqrt(F.col("rows").cast("double")) * SCALE).cast("long"))
    found = per.orderBy(F.desc("rows"), F.col("source").asc_nulls_first()).collect()
    if not found:
        return keys.select("id", "source", "n", *[F.lit(0).cast("long").alias(c) for c in ("block", "release", "deadline", "slot", "place")])
    whole = [r["target"] for r in found] if weights is None else whole_weights([weights.get(r["source"], 0) for r in found])
    if not any(whole):
        whole = [1] * len(found)
    blocks = [-(-r["k"] // block_rows) for r in found]
    on = [i for i, w in enumerate(whole) if w]
    late = [i for i, w in enumerate(whole) if not w]
    plan = schedule(spark, [whole[i] for i in on], [blocks[i] for i in on], period)
    # sources of weight 0 start behind the last slot, each behind the one before
    start, starts = max(-(-blocks[i] * sum(whole) // whole[i]) for i in on), [None] * len(on)
    for i in late:
        starts.append(start)
        start += blocks[i]
    names = [F.struct(F.lit(found[i]["source"]).cast("string").alias("other"), F.lit(r).alias("rank"), F.lit(starts[r]).cast("long").alias("start")) for r, i in enumerate([*on, *late])]
    ranks = spark.range(1).select(F.inline(F.array(*names)))

    # numbering within each source: range-partition by source and id, count per range, add what lies before
    by = (F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first())
    n_keys = sum(r["k"] for r in found)
    ranged = keys.repartitionByRange(min(MOST_RANGES, max(1, -(-n_keys // RANGE_ROWS))), *by).sortWithinPartitions(*by)
    ranged = cut(ranged.select("*", F.monotonically_increasing_id().alias("at")), "mix-ranged").withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first_at"))
    before = F.sum("rows").over(Window.partitionBy("source").orderBy("part")) - F.col("rows")
    parts = parts.select(F.col("source").alias("name"), F.col("part").alias("p"), (before - F.col("first_at")).alias("shift"))
    parts = parts.join(ranks, F.col("name").eqNullSafe(F.col("other"))).drop("other")
    number = F.col("at") + F.col("shift")
    ranked = ranged.join(parts, F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("p")))
    ranked = ranked.select("id", "source", "n", "rank", "start", F.floor(number / block_rows).alias("block"), (number % block_rows).alias("place"))
    late_slot = F.col("start") + F.col("block")
    slots = [F.coalesce(c, late_slot + more).alias(c) for c, more in (("release", 0), ("deadline", 1), ("slot", 0))]
    return ranked.join(plan, ["rank", "block"], "left").select("id", "source", "n", "block", *slots, "place")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All rows of ``docs`` in mixed order, with their own columns only; rows of equal id and source stand in the order of their hashes."""
    at = places(docs, id_col, source_col, **options).select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("slot").alias("__slot"), F.col("place").alias("__place"))
    rows = docs.join(at, docs[id_col].eqNullSafe(F.col("__id")) & docs[source_col].cast("string").eqNullSafe(F.col("__source")))
    tie = F.xxhash64(*[docs[f.name] for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    return rows.orderBy("__slot", "__place", tie).select(*[docs[c] for c in docs.columns])
