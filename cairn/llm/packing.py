"""Packing: window cuts by order-preserving dynamic programming.

The ids of documents stand one after another in order; a sequence is a run of
at most ``WINDOW`` ids and is padded to ``WINDOW`` unless its length is a power
of two.  Allowed cuts are document ends (free), sentence ends and, where
neither comes within ``STRIDE`` ids, forced places (each with a truncation
penalty).  The cheapest cuts minimise padding, penalties and a small cost per
sequence:

    best[j] = penalty[j] + cost + min(best[i] + WINDOW - (p[j] - p[i]))

over cuts i with p[j] - p[i] <= WINDOW, from a monotone queue of
``best[i] + p[i]``; power-of-two lengths are tried beside it without padding.

The order is cut into ranges, whose number is bounded, and a range into units of
whole documents that are packed one after another, so a task holds one unit (or
one document, if that is longer).  Defined cases: a null text counts as empty and
packs its end id alone; a document longer than a window is cut into several
pieces; repeated rows are packed as often as they occur; rows that tie in the
order stand by a hash of their ids; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut
from cairn.llm.tokens import END, tokenize, vocabulary_path

WINDOW = 4096
#: Truncation penalties in ids of padding, and the cost of a sequence.
SENTENCE = 8
FORCED = 48
PER_SEQUENCE = 64
STRIDE = 256
#: Ids of one independently packed unit, and ranges at most.
UNIT_IDS, MOST_RANGES = 1_500_000, 4096
#: Local sequence numbers per range: ``range * SPAN + number``.
SPAN = 1 << 32


@lru_cache(maxsize=2)
def sentence_ids(path: str) -> np.ndarray:
    """Which ids end a sentence: stops with optional closing marks, at a word's end."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    stop = re.compile(r"[.!?]+['\")\]]*</w>")
    out = np.zeros(1 << 16, bool)
    out[[i for text, i in tokenizer.get_vocab().items() if stop.fullmatch(text)]] = True
    return out


def candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, stride: int = STRIDE):
    """Cut positions and their penalties; the last position is the end of the ids."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int32)
    penalty[1:][stops[ids]] = SENTENCE
    penalty[ends] = 0
    penalty[0] = penalty[n] = 0
    at = np.nonzero(penalty >= 0)[0]
    gap = np.diff(at)
    wide = np.nonzero(gap > stride)[0]
    if len(wide):
        more = np.concatenate([np.arange(at[i] + stride, at[i + 1], stride) for i in wide])
        penalty[more] = FORCED
        at = np.nonzero(penalty >= 0)[0]
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The cheapest cuts among ``at`` (first to last, steps at most ``window``)."""
    n = len(at)
    powers = [[] for _ in range(n)]
    k = 1
    while k <= window:
        i = np.searchsorted(at, at - k)
        hit = np.nonzero((at >= k) & (at[np.minimum(i, n - 1)] == at - k))[0]
        for j, before in zip(hit.tolist(), i[hit].tolist()):
            powers[j].append(before)
        k *= 2
    p, pen = at.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue = deque([(0, 0, 0)])  # (best + position, position, index), increasing in the first
    for j in range(1, n):
        pj = p[j]
        while queue[0][1] < pj - window:
            queue.popleft()
        low, _, i = queue[0]
        cost = low + window - pj
        for q in powers[j]:
            if best[q] < cost:
                cost, i = best[q], q
        cost += pen[j] + PER_SEQUENCE
        best[j], back[j] = cost, i
        key = cost + pj
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, pj, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return at[cuts[::-1]]


def pack_range(ids: np.ndarray, counts: np.ndarray, stops: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Pieces of a range of documents: document index, start in it, length, sequence, offset, place."""
    ends = np.cumsum(counts)
    cuts = best_cuts(*candidates(ids, ends, stops, min(STRIDE, window)), window)
    edges = np.union1d(cuts, ends)
    first = edges[:-1] if edges[0] == 0 else np.concatenate([[0], edges[:-1]])
    last = edges[1:] if edges[0] == 0 else edges
    doc = np.searchsorted(ends, first, side="right")
    seq = np.searchsorted(cuts, first, side="right") - 1
    return {"doc": doc, "start": first - (ends - counts)[doc], "length": last - first, "sequence": seq, "offset": first - cuts[seq], "place": first}


def _units(batches, unit_ids):
    """Documents and their ids in units of about ``unit_ids`` ids: ``(docs, counts, ids)``."""
    tables, parts, held = [], [], 0
    for batch in batches:
        counts, first = batch.column("n").to_numpy(), 0
        while first < batch.num_rows:
            room = np.searchsorted(np.cumsum(counts[first:]), unit_ids - held, side="right")
            last = min(batch.num_rows, first + max(int(room), 0 if tables else 1))
            if last > first:
                some = batch.slice(first, last - first)
                parts += [np.frombuffer(v.as_buffer(), np.uint16).copy() for v in some.column("ids")]
                tables.append(some.select(["id", "n"]))
                held += int(counts[first:last].sum())
            if last < batch.num_rows:
                yield pa.Table.from_batches(tables).combine_chunks(), np.concatenate(parts)
                tables, parts, held = [], [], 0
            first = last
    if tables:
        yield pa.Table.from_batches(tables).combine_chunks(), np.concatenate(parts)


def _run(path, window, whole, unit_ids):
    def run(batches):
        base = TaskContext.get().partitionId() * SPAN
        for docs, ids in _units(batches, unit_ids):
            counts = docs.column("n").to_numpy()
            got = pack_range(ids, counts, sentence_ids(path), window)
            step = 20_000
            for at in range(0, len(got["doc"]), step):
                cut_ = {k: v[at : at + step] for k, v in got.items()}
                wide = [ids[a : a + n].astype("<u4").tobytes() for a, n in zip(cut_["place"], cut_["length"])]
                doc = pa.array(cut_["doc"])
                columns = {
                    "id": docs.column("id").combine_chunks().take(doc),
                    "start": pa.array(cut_["start"]),
                    "length": pa.array(cut_["length"]),
                    "ids": pa.array(wide, pa.binary()) if whole else pa.array([zlib.crc32(w) for w in wide], pa.int64()),
                    "doc_tokens": pa.array(counts).take(doc),
                    "sequence": pa.array(cut_["sequence"] + base),
                    "offset": pa.array(cut_["offset"]),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=[k if whole or k != "ids" else "ids_crc32" for k in columns])
            base += int(got["sequence"][-1]) + 1

    return run


def pack_tokens(tokens: DataFrame, order: list[str], path: str | None = None, window: int = WINDOW, unit_ids: int = UNIT_IDS, whole: bool = True) -> DataFrame:
    """Pieces of ``tokens`` (``id, n, ids`` and the columns of ``order``), in that order.

    Returns ``id, start, length, ids`` (little-endian 32-bit; or ``ids_crc32``),
    ``doc_tokens, sequence, offset``.
    """
    kind = tokens.schema["id"].dataType.simpleString()
    total = tokens.agg(F.sum("n")).first()[0] or 0
    by = [*[F.col(c).asc_nulls_first() for c in order], F.xxhash64("ids")]
    ranges = min(MOST_RANGES, max(1, -(-total // unit_ids)))
    # the row's number splits even rows that are equal in everything
    ranged = tokens.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(ranges, *by, "__row")
    ranged = ranged.sortWithinPartitions(*by, "__row").select("id", "n", "ids")
    last = "ids binary" if whole else "ids_crc32 long"
    return ranged.mapInArrow(_run(path or vocabulary_path(), window, whole, unit_ids), f"id {kind}, start long, length long, {last}, doc_tokens long, sequence long, offset long")


def pack(docs: DataFrame, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, whole: bool = True) -> DataFrame:
    """Tokenize whole texts and pack them in ascending order of ``order`` (default: the id)."""
    path = path or vocabulary_path()
    keys = [F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order or [id_col])]]
    named = docs.select(*keys)
    by = [c for c in named.columns if c not in ("id", "__text")]
    tokens = cut(tokenize(named, ["id", *by], "__text", path, end), "pack-ids")
    return pack_tokens(tokens, by, path, whole=whole)
