"""Matching two sets of feature rows: inverted-index candidates, scores, ranked matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import similarity
from cairn.operators.grouping import top_per_group
from cairn.storage import cut

#: Weight of one shared feature when candidates are gathered, and candidates kept per row.
CANDIDATE_WEIGHTS = {"strings": 4, "imports": 3, "constants": 2, "ngrams": 1}
CANDIDATES = 64
#: Bits of the table that tells most features that only one side has; features of either side in a cell; meetings worked on at once, and the least number of cells.
SEEN_BITS, CELL_A, CELL_B, MEETINGS, CELLS = 1 << 27, 1 << 20, 1 << 20, 1 << 19, 8


def candidates(a: DataFrame, b: DataFrame, key: str = "key", weights: dict[str, int] = CANDIDATE_WEIGHTS, keep: int | None = CANDIDATES) -> DataFrame:
    """``a, b, weight`` and ``shared_<kind>``: for each row of ``a`` the ``keep`` rows of ``b`` that share most features (None: all), ties by key.

    Features of all kinds go through one join; within a side each is distinct,
    so the rows of a pair count what its sets have in common.
    """
    def marked(kind, w):
        return F.transform(F.array_distinct(F.col(kind).cast("array<string>")), lambda f: F.struct(F.lit(kind).alias("kind"), F.lit(w).alias("w"), f.alias("feature")))

    def exploded(df, name):
        # one pass over the rows, whatever the number of kinds
        none = F.array().cast("array<struct<kind:string,w:int,feature:string>>")
        lists = [F.coalesce(marked(kind, w), none) for kind, w in weights.items() if kind in df.columns]
        return df.select(F.col(key).alias(name), F.explode(F.concat(*lists)).alias("f")).select(name, "f.*")

    pairs = exploded(a, "a").join(exploded(b, "b").drop("w"), ["kind", "feature"])
    shared = [F.count_if(F.col("kind") == k).alias(f"shared_{k}") for k in weights if k in a.columns and k in b.columns]
    weighed = pairs.groupBy("a", "b").agg(F.sum("w").alias("weight"), *shared)
    return weighed if keep is None else top_per_group(weighed, ["a"], [F.desc("weight"), F.col("b")], keep).drop("rank")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists and the rows that they are in, without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = values.is_valid()
    return tuple(x.filter(there).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for x in (values, rows))


def _lean(df: DataFrame, key: str, kinds: list[str], label: str, seen=None) -> DataFrame:
    """``df`` with ``n_<kind>`` and hashes ``h_<kind>`` in place of sets, written once; with ``seen`` only hashes whose bits are set there."""
    def hashes(kind):
        return F.transform(F.array_distinct(F.col(kind).cast("array<string>")), lambda x: F.when(x.isNotNull(), F.xxhash64(F.lit(kind), x)))

    plain = [c for c in df.columns if c not in CANDIDATE_WEIGHTS]
    rows = df.where(F.col(key).isNotNull()).select(*plain, *[hashes(c).alias(f"h_{c}") for c in kinds])
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in plain), *(f"n_{c} int, h_{c} array<bigint>" for c in kinds)])

    def run(batches):
        bits = None if seen is None else seen.value
        for batch in batches:
            out = {c: batch.column(c) for c in plain}
            for c in kinds:
                lists = batch.column(f"h_{c}")
                out[f"n_{c}"] = pc.list_value_length(lists).cast(pa.int32())
                values, of = _flat(lists)
                if bits is not None:
                    there = _set(bits, values)
                    values, of = values[there], of[there]
                edges = np.zeros(len(lists) + 1, np.int32)
                np.cumsum(np.bincount(of, minlength=len(lists)), out=edges[1:])
                out[f"h_{c}"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return cut(rows.mapInArrow(run, schema), label)


def _set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (SEEN_BITS - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _seen(lean: DataFrame, kinds: list[str]):
    """Bits of the features of a side, for all executors."""
    at = F.col("f").bitwiseAND(F.lit(SEEN_BITS - 1))
    features = lean.select(F.explode(F.concat(*[F.col(f"h_{c}") for c in kinds])).alias("f"))
    words = features.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, CAST(f & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(SEEN_BITS >> 6, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return lean.sparkSession.sparkContext.broadcast(bits)


def _meet(weights: dict[str, int], keep: int, itself: bool):
    """A cell's rows of both sides to its ``keep`` best pairs for each row of ``a``: exact counts, no pair is ever a row before."""
    kinds, weight = list(weights), np.array(list(weights.values()), np.int64)

    def side(rows):
        keys = pc.unique(rows.column("key").combine_chunks())
        keys = keys.take(pc.sort_indices(keys))
        code = pc.index_in(rows.column("key").combine_chunks(), keys).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [_flat(rows.column(f"h_{c}")) for c in kinds]
        kind = np.repeat(np.arange(len(kinds)), [len(v) for v, _ in parts])
        return keys, np.concatenate([v for v, _ in parts]), code[np.concatenate([r for _, r in parts])], kind

    def best(found):
        a, b, w, *shared = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, -w, a))
        first = np.r_[True, a[order][1:] != a[order][:-1]]
        place = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        order = order[place < keep]
        return [tuple(x[order] for x in (a, b, w, *shared))]

    def run(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        left = table.column("left")
        a_keys, f, a_of, _ = side(table.filter(left))
        b_keys, g, b_of, kind = side(table.filter(pc.invert(left)))
        order = np.argsort(f, kind="stable")
        a_of = a_of[order]
        known, start, n = np.unique(f[order], return_index=True, return_counts=True)
        found, held = [], 0
        if len(known) and len(g):
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = np.nonzero(known[at] == g)[0]
            hit = hit[np.argsort(b_of[hit], kind="stable")]
            at, b_of, kind = at[hit], b_of[hit], kind[hit]
            upto = np.cumsum(n[at])
            ends = np.nonzero(np.r_[b_of[1:] != b_of[:-1], True])[0] + 1 if len(at) else []  # a row of b is never cut
            same = np.full(len(b_keys), -1) if itself else pc.fill_null(pc.index_in(b_keys, a_keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            i = 0
            while i < len(at):
                done = upto[i - 1] if i else 0
                j = int(ends[min(max(np.searchsorted(upto[ends - 1], done + MEETINGS, "right") - 1, np.searchsorted(ends, i, "right")), len(ends) - 1)])
                many = n[at[i:j]]
                row = np.repeat(np.arange(i, j), many)
                place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                pair = (a_of[start[at[row]] + place] * len(b_keys) + b_of[row]) * len(kinds) + kind[row]
                pair, times = np.unique(pair, return_counts=True)
                of, pair = pair % len(kinds), pair // len(kinds)
                pair, first = np.unique(pair, return_index=True)
                a, b = pair // len(b_keys), pair % len(b_keys)
                sums = [np.add.reduceat(x, first) for x in (weight[of] * times, *(np.where(of == k, times, 0) for k in range(len(kinds))))]
                other = same[b] != a
                found.append(tuple(x[other] for x in (a, b, *sums)))
                held += len(a)
                if held > MEETINGS:
                    found = best(found)
                    held = len(found[0][0])
                i = j
        a, b, *sums = best(found)[0] if found else (np.zeros(0, np.int64),) * (3 + len(kinds))
        return pa.table([a_keys.take(pa.array(a)), b_keys.take(pa.array(b)), *map(pa.array, sums)], names=["a", "b", "weight", *(f"shared_{c}" for c in kinds)])

    return run


def best_candidates(a: DataFrame, b: DataFrame, weights: dict[str, int], keep: int = CANDIDATES, itself: bool = True) -> DataFrame:
    """What ``candidates`` gives, from lean sides, without a row for every feature that a pair shares.

    Rows of both sides meet in cells (a part of ``a`` with a part of ``b``), whose
    tasks count in sorted arrays and hand over the best of each row of ``a``.
    Features are told apart by 64-bit hashes. Without ``itself``, rows of equal
    keys are no candidates of each other.
    """
    lists = [f"h_{c}" for c in weights]
    total = lambda df: df.agg(F.sum(sum((F.size(c) for c in lists[1:]), F.size(lists[0])).cast("long"))).first()[0] or 0
    n, m = -(-total(a) // CELL_A) or 1, max(CELLS, -(-total(b) // CELL_B))
    i, j = F.pmod(F.xxhash64("key"), F.lit(n)), F.pmod(F.xxhash64("key"), F.lit(m))
    left = a.select("key", *lists, F.lit(True).alias("left"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")).alias("j"))
    right = b.where(sum((F.size(c) for c in lists[1:]), F.size(lists[0])) > 0).select("key", *lists, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("i"), j.alias("j"))
    types = [f"{name} {df.schema['key'].dataType.simpleString()}" for name, df in (("a", a), ("b", b))]
    met = left.unionByName(right).groupBy("i", "j").applyInArrow(_meet(weights, keep, itself), ", ".join([*types, "weight long", *(f"shared_{c} long" for c in weights)]))
    return top_per_group(met, ["a"], [F.desc("weight"), F.col("b")], keep).drop("rank")


def _sides(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str, columns) -> DataFrame:
    """``pairs`` with what ``columns`` makes of either side as structs ``x`` and ``y``."""
    sides = pairs.join(a.select(F.col(key).alias("a"), F.struct(*columns(a)).alias("x")), "a")
    return sides.join(b.select(F.col(key).alias("b"), F.struct(*columns(b)).alias("y")), "b")


def compare(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """``pairs`` (``a, b``) with every component, the ``score``, ``agreeing`` and ``abstained``.

    Where the pairs come with ``shared_<kind>`` counts, only the sizes of the
    sets travel; else the sets themselves are compared.
    """
    held = [{*df.columns, *(c[2:] for c in df.columns if c.startswith("n_"))} for df in (a, b)]
    both = [c for c in similarity.CONTENT if all(c in h for h in held)]
    counted = [c for c in both if f"shared_{c}" in pairs.columns]
    counters = [c for c in ("size", "calls", "branches", "returns") if c in a.columns]
    plain = [*counters, *(["signature"] if "signature" in a.columns else [])]

    def columns(side):
        sizes = [F.col(f"n_{c}") if f"n_{c}" in side.columns else F.size(F.array_distinct(c)).alias(f"n_{c}") for c in counted]
        return [*sizes, *[F.col(c) for c in both if c not in counted], *[F.col(c) for c in plain], F.lit(0).alias("_")]

    x, y, parts = F.col("x"), F.col("y"), {}
    for c in both:
        if c in counted:
            shared = F.col(f"shared_{c}")
            parts[c] = shared / F.nullif(x[f"n_{c}"] + y[f"n_{c}"] - shared, F.lit(0))
        else:
            parts[c] = similarity.jaccard(x[c], y[c])
    if "signature" in plain:
        parts["signature"] = F.when(x["signature"] == y["signature"], 1.0).otherwise(0.0)
    if counters:
        parts["shape"] = similarity.shape([(x[c], y[c]) for c in counters])
    sides = _sides(pairs, a, b, key, columns)
    named = sides.select("a", "b", *[c.cast("double").alias(f"c_{n}") for n, c in parts.items()])
    made = {n: F.col(f"c_{n}") for n in parts}
    return named.select(
        "a", "b", *[F.col(f"c_{n}").alias(n) for n in parts], similarity.weighted(made).alias("score"), similarity.agreeing(made).alias("agreeing"), similarity.abstained(made).alias("abstained")
    )


def match(a: DataFrame, b: DataFrame, key: str = "key", min_score: float = 0.55, min_agreeing: int = 2, top: int = 3, most: int | None = None, itself: bool = True) -> DataFrame:
    """Matches of ``a`` in ``b``: thresholds on the rounded score, ``top`` per row of ``a``, best first.

    ``most`` is a limit over all matches (none by default: nothing is dropped).
    Without ``itself`` a row is not matched with the row of the same key.
    """
    weights = {c: w for c, w in CANDIDATE_WEIGHTS.items() if c in a.columns and c in b.columns}
    names = [c for c in ("size", "calls", "branches", "returns", "signature") if c in a.columns and c in b.columns]
    sides = [df.select(F.col(key).alias("key"), *names, *weights) for df in (a, b)]
    a = _lean(sides[0], "key", list(weights), "match-a")
    b = _lean(sides[1], "key", list(weights), "match-b", _seen(a, list(weights)))
    scored = compare(best_candidates(a, b, weights, itself=itself).drop("weight"), a, b)
    good = scored.where((F.col("score") >= min_score) & (F.col("agreeing") >= min_agreeing))
    ranked = top_per_group(good, ["a"], [F.desc("score"), F.desc("agreeing"), F.col("b")], top)
    return ranked if most is None else ranked.orderBy(F.desc("score"), F.desc("agreeing"), "a", "b").limit(most)


def ambiguity(matches: DataFrame, a: DataFrame, key: str = "key") -> DataFrame:
    """One row: rows of ``a`` matched, matched more than once, tied at their best score, not matched."""
    best = F.max("score").over(Window.partitionBy("a"))
    per_a = matches.withColumn("best", best).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == F.col("best")).alias("ties"))
    joined = a.select(F.col(key).alias("a")).join(per_a, "a", "left")
    return joined.agg(
        F.count_if(F.col("n") > 0).alias("matched"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("ties") > 1).alias("tied"), F.count_if(F.col("n").isNull()).alias("unmatched")
    )
