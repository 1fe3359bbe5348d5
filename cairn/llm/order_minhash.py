"""Document fingerprints by Order MinHash.

A text's k-mers (runs of ``K`` code points) are numbered by occurrence, so that
repeats count.  Each of ``ENTRIES`` orders, given by a hash of its own, picks the
``PICKED`` minimal pairs (k-mer, occurrence); they are put back into text order
and the tuple of their k-mers is hashed to one entry of the fingerprint.  Equal
entries thus need the same minimal k-mers in the same order, which edits and
moves both disturb.  The likeness of two fingerprints is the share of equal
entries to the power ``1 / PICKED``.

Texts are shuffled once, into ranges of neighbouring documents whose number is
bounded; a range is sorted and streamed, so a task holds a few texts at a time.
The first row of every range also goes to the range before it.

Defined cases: a null text counts as empty; the empty text's fingerprint is all
zeros; a text shorter than ``K`` is one k-mer.  Documents follow each other by
ascending id (null ids first, equal ids by a hash of the text, then the text)
and the last is followed by the first; a single document is followed by itself.
Ids may be of any type with an order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import parts_of, text_bytes, tidy, values

K = 8
ENTRIES = 64
PICKED = 2
#: Text bytes of one range of neighbouring documents, ranges at most, and keys drawn per range for their limits.
RANGE_BYTES, MOST_RANGES, DRAWN = 4 << 20, 4096, 40
#: K-mers that the orders are applied to at once.
AT_ONCE = 4096
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ORDERS = np.random.default_rng(17).integers(0, 1 << 31, (2, ENTRIES, 1)).astype(np.uint32)
_XOR, _TIMES = _ORDERS[0], _ORDERS[1] * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _TWO
    x = (x ^ (x >> np.uint64(27))) * _THREE
    return x ^ (x >> np.uint64(31))


def _sorted_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in ascending order (equal ones by place) and their places."""
    n = len(values)
    if n < 1 << 24:  # the upper 40 bits and the place fit one word
        key = np.sort((values & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64))
        return key & ~np.uint64(0xFFFFFF), (key & np.uint64(0xFFFFFF)).astype(np.int64)
    at = np.argsort(values, kind="stable")
    return values[at] & ~np.uint64(0xFFFFFF), at


def _smallest(pair: np.ndarray) -> np.ndarray:
    """Places of the ``PICKED`` smallest values of every order; equal values by place."""
    rows = np.arange(ENTRIES)
    best = place = None
    for at in range(0, len(pair), AT_ONCE):
        part = (pair[at : at + AT_ONCE] ^ _XOR) * _TIMES
        value, where = [], []
        for _ in range(min(PICKED, part.shape[1])):
            low = part.argmin(axis=1)
            value.append(part[rows, low].astype(np.int64))
            where.append(low + at)
            part[rows, low] = 0xFFFFFFFF
        value, where = np.stack(value, axis=1), np.stack(where, axis=1)
        if best is not None:
            value, where = np.concatenate([best, value], axis=1), np.concatenate([place, where], axis=1)
            order = np.argsort(value, axis=1, kind="stable")[:, :PICKED]
            value, where = np.take_along_axis(value, order, axis=1), np.take_along_axis(where, order, axis=1)
        best, place = value, where
    return place


def entries(text: str) -> np.ndarray:
    """The fingerprint's entries, unsigned 32-bit."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(ENTRIES, np.uint32)
    n = max(1, len(points) - K + 1)
    kmer = np.zeros(n, np.uint64)
    for j in range(min(K, len(points))):
        kmer *= _ONE
        kmer += points[j : n + j]
    kmer = _mix(kmer + np.uint64(1))
    value, place = _sorted_places(kmer)
    first = np.concatenate([[True], value[1:] != value[:-1]])
    run = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[place] = run - np.maximum.accumulate(np.where(first, run, 0))
    picked = _smallest((_mix(kmer + occurrence * _ONE) >> np.uint64(32)).astype(np.uint32))
    picked.sort(axis=1)
    out = np.zeros(ENTRIES, np.uint64)
    for j in range(picked.shape[1]):
        out = _mix(out * _ONE + kmer[picked[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def as_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean() ** (1 / PICKED))


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """A column function: text to its fingerprint."""
    return pa.array([as_text(entries(t or "")) for t in values(texts)], pa.string())


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _limits(drawn: pa.Table, ranges: int) -> list[tuple]:
    """Keys (id, tie) at which ranges start, ascending; null ids first."""
    keys = sorted(set(zip(drawn.column("id").to_pylist(), drawn.column("tie").to_pylist())), key=_order)
    return [keys[i] for i in np.unique(np.linspace(0, len(keys), ranges + 1).astype(int)[1:-1])] if len(keys) > 1 else []


def _order(key):
    return (False, 0, key[1]) if key[0] is None else (True, key[0], key[1])


def _deal(shared):
    """Rows with the number of their range; the first row of a range also goes to the range before it."""

    def run(batches):
        limits, low = shared.value
        orders, starts, heads = [_order(k) for k in limits], {k: i for i, k in enumerate(limits)}, {}
        whole = all(isinstance(i, int) for i, _ in limits)
        edges = np.array([i for i, _ in limits]) if whole and limits else None
        for batch in parts_of(batches):
            ids, ties, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if edges is not None and None not in ids:  # whole numbers all at once; equal ones are looked at again
                part = np.searchsorted(edges, ids, side="left").astype(np.int64)
                for r in np.nonzero(edges[np.minimum(part, len(edges) - 1)] == ids)[0]:
                    part[r] = bisect_right(orders, _order((ids[r], ties[r])))
            else:
                part = np.array([bisect_right(orders, _order(k)) for k in zip(ids, ties)], np.int64)
            texts = [t or "" for t in texts]
            for key, t in zip(zip(ids, ties), texts):
                for to in ([starts[key]] if key in starts else []) + ([len(limits)] if key == low else []):
                    if (key, to) not in heads or t < heads[key, to]:
                        heads[key, to] = t
            yield _rows(part, np.zeros(len(part), bool), batch.column(0), batch.column(1), texts)
        tidy()
        if heads:
            keys = list(heads)
            yield _rows(np.array([to for _, to in keys]), np.ones(len(keys), bool), pa.array([k[0] for k, _ in keys], batch.column(0).type), pa.array([k[1] for k, _ in keys], pa.int64()), list(heads.values()))

    return run


def _rows(part, head, ids, ties, texts):
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(head), ids, ties, pa.array(texts, pa.string())], names=["part", "head", "id", "tie", "text"])


KINDS = (("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()), ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()))


def _compare(batches):
    """Stream the rows of sorted ranges: each row waits for the one after it (of several heads the first counts)."""
    before = None  # part, id, text, entries of the row that waits
    for batch in parts_of(batches, 256):
        out, ids = [], []
        for part, head, ident, text in zip(*(batch.column(c).to_pylist() for c in ("part", "head", "id", "text"))):
            own = entries(text)
            if before is not None and before[0] == part:
                _, first, was, found = before
                new = edited(was, text)
                other = entries(new)
                ids.append(first)
                out.append((len(was), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(found), as_text(other), likeness(found, other), likeness(found, own)))
            before = None if head else (part, ident, text, own)
        columns = [pa.array(c, k) for c, (_, _, k) in zip(zip(*out) if out else [[]] * len(KINDS), KINDS)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), *columns], names=["id", *(n for n, _, _ in KINDS)])
    tidy()


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    Limits of the ranges are drawn keys (at most ``DRAWN * MOST_RANGES`` reach
    the driver), so the head of each range is known beforehand.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    smallest = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie"))
    n, low = rows.agg(F.count(F.lit(1)), smallest).first()
    ranges = min(MOST_RANGES, max(1, -(-text_bytes(rows, "text") // range_bytes)))
    share = min(1.0, DRAWN * ranges / max(1, n))
    drawn = rows.select("id", "tie").where(F.pmod(F.xxhash64("id", "tie"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    low = None if low is None else (low["id"], low["tie"])
    limits = [k for k in _limits(drawn.limit(4 * DRAWN * ranges).toArrow(), ranges) if k != low]
    shared = spark.sparkContext.broadcast((limits, low))
    dealt = rows.mapInArrow(_deal(shared), f"part long, head boolean, id {kind}, tie long, text string")
    placed = dealt.repartition(ranges, "part").sortWithinPartitions("part", "head", F.col("id").asc_nulls_first(), "tie", "text")
    return placed.drop("tie").mapInArrow(_compare, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in KINDS))
