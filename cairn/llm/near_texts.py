"""Near-duplicate texts by SimHash at a word-shingle similarity: bit-sliced search, exact check.

``simhash`` links fingerprints at three of 64 bits; texts whose five-word
shingles agree to 0.8 differ in about one bit of seven.  Here a fingerprint has
256 bits (one bit per position that more than half of the text's distinct shingles
set), and two texts are links if their shingle sets have a Jaccard similarity of
at least ``SIMILARITY``.

Candidates: tables of ``bits`` drawn positions each; texts that agree on all
positions of a table meet in a group.  The number of tables follows from the
number of bits, so that a pair at 0.8 meets in some table with a chance of
``RECALL``; the number of bits follows from the number of distinct fingerprints,
so that groups stay small at every size (keys a text then grow as its power 0.24).
A key with many members is dealt to groups of two chunks each, so that no task
gets an unbounded group and no meeting is lost.

Comparison: the fingerprints of many groups lie side by side as 256 vertical bit
planes.  Against a copy shifted by one, two, ... lanes, difference planes go
through carry-save adders into bitwise counters that overflow beyond ``RADIUS``;
blocks of 64 lanes are abandoned once all have.  Inside a group a shortest
spanning forest of what is left is kept, never all pairs; its edges are checked
exactly against the shingle sets and the rest are links.  Texts of pairs that a
forest leaves out meet once more, with their shingle sets, in the groups that
still have several labels: there every such pair is checked where it first meets,
and again only a forest of links leaves the group.

Defined cases: a null text counts as empty; texts without words are copies of one
another; fewer words than a shingle has are one shingle; texts of one fingerprint
are copies; rows of equal id and fingerprint are one row; of a group the smallest
id stays (known ids before null ones).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, parts_of, raw_text, release, tidy
from cairn.llm.hashing import mix
from cairn.llm.lm import word_keys
from cairn.llm.simhash import components

WORDS, SIMILARITY = 5, 0.8
BITS = 256
#: Differing bits up to which a candidate is checked: 39 are expected at 0.8, with a deviation of 5.7.
RADIUS = 62
RECALL = 0.99
#: Fingerprints of one chunk of a hot key (a group has at most two chunks), and keys that are looked up by broadcast at most.
CHUNK, MOST_HOT = 4096, 200_000
#: Places that the copies of one fingerprint are spread over where they meet others.
SALTS = 16
#: Bytes of shingle sets of one chunk where texts meet with them (a longer set is a chunk of its own).
SET_BYTES = 16 << 20
#: Lanes that lie side by side.
AT_ONCE = 1 << 16
_ODD = np.random.default_rng(23).integers(1, 1 << 62, 4).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(raws: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's shingles."""
    keys, counts = word_keys(raws)
    out, at = [], 0
    for n in counts.tolist():
        own = keys[at : at + n]
        at += n
        size = max(1, n - words + 1) if n else 0
        h = np.zeros(size, np.uint64)
        for j in range(min(words, n)):
            h = h * _STEP + own[j : size + j]
        out.append(np.unique(mix(h)))
    return out


def fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits: which positions more than half of the shingles set; all zero without shingles."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        wide = mix(hashes[at : at + (1 << 14), None] * _ODD)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _fingerprints(words):
    def run(batches):
        for batch in parts_of(batches, 256):
            found = shingle_hashes([r or b"" for r in batch.column(1).to_pylist()], words)
            fps = pa.array([fingerprint(h) for h in found], pa.binary())
            short = pa.array([np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, short], names=["id", "fp", "shingles"])
        tidy()

    return run


def table_shape(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` distinct fingerprints."""
    cosine = 2 * similarity / (1 + similarity)
    same = 1 - np.arccos(cosine) / np.pi
    bits = int(min(40, max(16, np.ceil(np.log2(max(2, n))) - 2)))
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - same**bits)))


def _picks(bits, tables) -> list[np.ndarray]:
    """The drawn positions of every table."""
    rng = np.random.default_rng(41)
    return [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(tables)]


def _keys(bits, tables):
    """The keys of fingerprints, each with the row's columns."""

    def run(batches):
        picks = _picks(bits, tables)
        power = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in parts_of(batches, 4096):
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            spread = np.unpackbits(fps, axis=1, bitorder="little")
            for t, pick in enumerate(picks):
                key = (spread[:, pick] * power).sum(axis=1, dtype=np.uint64) + (np.uint64(t) << np.uint64(bits))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", *batch.schema.names])

    return run


# ---- comparison of vertical bit planes


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of bytes), 64 lanes per word; absent lanes are zero."""
    fps = np.pad(fps, ((0, -len(fps) % 64), (0, 0)))
    out = []
    for at in range(0, len(fps), 1 << 12):
        spread = np.unpackbits(fps[at : at + (1 << 12)], axis=1, bitorder="little")
        out.append(np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little"))
    return np.ascontiguousarray(np.concatenate(out, axis=1)).view(np.uint64)


def _adder(a, b, c):
    """Carry-save: three planes to a plane of sums and one of carries."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _count(counters, over, carry, level):
    """Add a plane of weight ``2**level`` to the counters; what leaves them is an overflow."""
    for k in range(level, len(counters)):
        counters[k], carry = counters[k] ^ carry, counters[k] & carry
    return over | carry


def beyond(difference, n_planes: int, start: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (bits of words) in which more than ``radius`` of the difference planes are set.

    ``difference(plane, words)`` gives a plane at some words; lanes set in ``start``
    are beyond from the outset, and words all of whose lanes are, are abandoned.
    """
    full = ~np.uint64(0)
    size = radius.bit_length()
    live = np.nonzero(start != full)[0]
    over, out = start[live], start.copy()
    first = (1 << size) - 1 - radius  # so that the counters overflow beyond the radius
    counters = [np.full(len(live), full if first >> k & 1 else 0, np.uint64) for k in range(size)]
    for p in range(0, n_planes, 4):
        one, two = _adder(difference(p, live), difference(p + 1, live), difference(p + 2, live))
        rest = difference(p + 3, live)
        over = _count(counters, over, one, 0)
        over = _count(counters, over, rest, 0)
        over = _count(counters, over, two, 1)
        if p % 32 == 28:
            stay = over != full
            if not stay.all():
                out[live] = over
                live, over, counters = live[stay], over[stay], [c[stay] for c in counters]
                if not len(live):
                    return out
    out[live] = over
    return out


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of the same group within the radius; rows of a group stand together."""
    n, full = len(fps), ~np.uint64(0)
    planes = planes_of(fps)
    left, right = [], []
    for step in range(1, n):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        words, bits = np.uint64(step // 64), np.uint64(step % 64)
        mask = np.pad(same, (0, planes.shape[1] * 64 - len(same)))
        start = ~np.packbits(mask, bitorder="little").view(np.uint64)
        last = planes.shape[1] - 1

        def difference(p, live, words=int(words), bits=bits):
            low = planes[p, np.minimum(live + words, last)]
            if bits:
                low = (low >> bits) | (planes[p, np.minimum(live + words + 1, last)] << (np.uint64(64) - bits))
            return planes[p, live] ^ low

        near = np.unpackbits((~beyond(difference, BITS, start, radius) & full).view(np.uint8), bitorder="little")[: n - step]
        found = np.nonzero(near)[0]
        left.append(found)
        right.append(found + step)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def spanning(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which edges a shortest spanning forest takes (ties in the given order)."""
    root: dict[int, int] = {}

    def top(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    taken = []
    for e in np.argsort(distance, kind="stable").tolist():
        x, y = top(int(a[e])), top(int(b[e]))
        if x != y:
            root[x] = y
            taken.append(e)
    return np.array(taken, np.int64)


def _edges(radius, labelled: bool = False):
    """Edges within every list: a shortest spanning forest, and the ends of pairs that it leaves out with themselves; or (``labelled``) all pairs of different labels."""

    def flush(lists):
        sizes = np.array([len(x) for x in lists])
        fps = np.frombuffer(b"".join(r["fp"] for x in lists for r in x), np.uint8).reshape(-1, BITS // 8)
        a, b = close_pairs(fps, np.repeat(np.arange(len(lists)), sizes), radius)
        if labelled:
            codes: dict[bytes, int] = {}
            label = np.array([codes.setdefault(r["label"], len(codes)) for x in lists for r in x])
            taken = label[a] != label[b]
        else:
            words = fps.view(np.uint64)
            forest = spanning(a, b, np.bitwise_count(words[a] ^ words[b]).sum(axis=1))
            out = np.ones(len(a), bool)
            out[forest] = False
            ends = np.unique(np.concatenate([a[out], b[out]]))
            a, b = np.concatenate([a[forest], ends]), np.concatenate([b[forest], ends])
            taken = slice(None)
        a, b = fps[a[taken]], fps[b[taken]]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in side], pa.binary()) for side in (a, b)], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for row in batch.column(0):
                fps = [r for _, r in sorted({r["fp"]: r for r in row.as_py()}.items())]
                if labelled and len({r["label"] for r in fps}) == 1:
                    continue
                held.append(fps)
                n += len(fps)
                if n >= AT_ONCE:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)
        tidy()

    return run


def candidates(fps: DataFrame, n: int, similarity: float = SIMILARITY, radius: int = RADIUS, chunk: int = CHUNK, ends: bool = False) -> DataFrame:
    """Edges ``a, b`` (a < b) between distinct ``fp`` that are close in bits: a forest for every group of every table.

    With ``ends`` also the ends of pairs that forests leave out, as edges to
    themselves.
    """
    bits, tables = table_shape(n, similarity)
    keys = fps.select("fp").mapInArrow(_keys(bits, tables), "key long, fp binary")
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    hot = cut(hot.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("g")), "near-hot")
    dealt = _dealt(keys.join(F.broadcast(hot) if hot.count() <= MOST_HOT else hot, "key", "left"))
    groups = dealt.groupBy("key", "i", "j").agg(F.collect_list(F.struct("fp")).alias("fps"))
    found = groups.where(F.size("fps") > 1).select("fps").mapInArrow(_edges(radius), "a binary, b binary")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found if ends else found.where("a <> b")


def _dealt(keys: DataFrame) -> DataFrame:
    """Rows with a ``key`` of ``g`` chunks (null: one), dealt to groups ``i, j``: chunk ``c`` meets each chunk in the group (least, greatest)."""
    kept = [n for n in keys.columns if n != "g"]
    c = F.pmod(F.xxhash64("fp"), F.coalesce("g", F.lit(1))).cast("int")
    dealt = keys.select(*kept, c.alias("c"), F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)).alias("other"))
    return dealt.select(*kept, "c", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"))


def group_links(table: int, fps: np.ndarray, chunks: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], masks: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """A forest of the links between members of one group that have different labels (numbers from 0).

    Checked are the pairs within the radius that meet in no table before this one
    (``masks``: the positions of the tables, as words), and, where the group has
    two chunks, those of different chunks: each pair once in all groups.
    """
    # members of the most frequent label stand last: they need not be compared with one another
    most = np.bincount(labels).argmax()
    order = np.argsort(labels == most, kind="stable")
    label, words, chunk = labels[order], fps[order].view(np.uint64), chunks[order]
    sets = [sets[i] for i in order.tolist()]
    size = np.array([len(x) for x in sets])
    two = chunk.min() != chunk.max()
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    own, out = np.zeros(len(values) + 1, bool), []
    for x in range(int((label != most).sum())):
        y = x + 1 + np.nonzero(label[x + 1 :] != label[x])[0]
        if two:
            y = y[chunk[y] != chunk[x]]
        y = y[(size[y] >= similarity * size[x]) & (size[x] >= similarity * size[y])]
        differ = words[y] ^ words[x]
        near = np.bitwise_count(differ).sum(axis=1) <= radius
        y, differ = y[near], differ[near]
        for mask in masks[:table]:
            if not len(y):
                break
            fresh = (differ & mask).any(axis=1)
            y, differ = y[fresh], differ[fresh]
        if not len(y):
            continue
        own[places[edge[x] : edge[x + 1]]] = True
        for part in np.array_split(y, -(-int(size[y].sum()) // AT_ONCE) or 1):
            part = part[label[part] != label[x]]
            shared = np.array([np.count_nonzero(own[places[edge[k] : edge[k + 1]]]) for k in part.tolist()], np.int64)
            for k in part[shared >= similarity * (size[x] + size[part] - shared)].tolist():
                if label[k] != label[x]:
                    out.append((int(order[x]), int(order[k])))
                    label[label == label[k]] = label[x]
        own[places[edge[x] : edge[x + 1]]] = False
    return out


def _links_of_groups(bits, tables, radius, similarity):
    """Links ``a, b`` of groups whose rows (``key, i, j, c, fp, label, shingles``) stand together."""

    def links(rows, masks):
        codes: dict[bytes, int] = {}
        label = np.array([codes.setdefault(r["label"], len(codes)) for r in rows])
        if len(codes) < 2:
            return []
        fps = np.frombuffer(b"".join(r["fp"] for r in rows), np.uint8).reshape(-1, BITS // 8)
        sets = [np.frombuffer(r["shingles"], "<u4") for r in rows]
        table = (rows[0]["key"] & ((1 << 64) - 1)) >> bits
        found = group_links(table, fps, np.array([r["c"] for r in rows]), label, sets, masks, radius, similarity)
        return [(min(pair), max(pair)) for pair in ((rows[a]["fp"], rows[b]["fp"]) for a, b in found)]

    def run(batches):
        spread = np.zeros((tables, BITS), bool)
        for t, pick in enumerate(_picks(bits, tables)):
            spread[t, pick] = True
        masks = np.packbits(spread, axis=1, bitorder="little").view(np.uint64)
        held, at = [], None
        for batch in parts_of(batches, 512):
            out = []
            for row in batch.to_pylist():
                here = (row["key"], row["i"], row["j"])
                if here != at and held:
                    out += links(held, masks)
                    held = []
                at = here
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in zip(*out)], names=["a", "b"])
        out = links(held, masks) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in zip(*out)], names=["a", "b"])
        tidy()

    return run


def left_out_links(fps: DataFrame, again: DataFrame, labels: DataFrame, n: int, similarity: float = SIMILARITY, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between the fingerprints ``again`` (``fp``) that have different labels (``v, label``; without one its own).

    Every pair that meets in a group and is close in bits is checked against the
    shingle sets inside the group's task; a group gives at most one link fewer
    than it has labels.
    """
    bits, tables = table_shape(n, similarity)
    sets = _sets_of(fps, again)
    named = sets.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.octet_length("shingles").alias("size"))
    named = cut(named, "near-labelled")
    keys = named.mapInArrow(_keys(bits, tables), "key long, fp binary, label binary, size int")
    mixed = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"), F.min("label").alias("least"), F.max("label").alias("most"))
    chunks = F.ceil(F.greatest(F.col("n") / chunk, F.col("bytes") / SET_BYTES)).cast("int")
    mixed = cut(mixed.where("least <> most").select("key", F.greatest(chunks, F.lit(1)).alias("g")), "near-mixed")
    dealt = _dealt(keys.join(F.broadcast(mixed) if mixed.count() <= MOST_HOT else mixed, "key").select("key", "fp", "label", "g"))
    rows = dealt.join(sets, "fp").select("key", "i", "j", "c", "fp", "label", "shingles")
    together = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = cut(together.mapInArrow(_links_of_groups(bits, tables, radius, similarity), "a binary, b binary").distinct(), "near-more")
    release(sets, named, mixed)
    return links


def _similar(similarity):
    def run(batches):
        for batch in parts_of(batches, 1024):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets_of(fps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp, shingles`` of the wanted fingerprints (``fp``, distinct)."""
    if wanted.count() <= MOST_HOT:
        copies = fps.join(F.broadcast(wanted), "fp", "left_semi")
    else:  # the copies of a fingerprint meet it in several places, and one of them goes on from each
        spread = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        copies = fps.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["fp", "salt"], "left_semi")
    return cut(copies.groupBy("fp").agg(F.max("shingles").alias("shingles")), "near-sets")


def _verified(fps: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """Those of the edges whose texts are similar by their shingles."""
    ends = cut(edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "near-ends")
    sets = _sets_of(fps, ends)
    paired = edges.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    links = cut(paired.mapInArrow(_similar(similarity), "a binary, b binary"), "near-links")
    release(ends, sets)
    return links


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``id, fp`` of every row, and ``fp, label`` of every fingerprint: equal labels are near-duplicates; and the tables to release after use."""
    rows = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw"))
    kind = rows.schema["id"].dataType.simpleString()
    fps = cut(rows.mapInArrow(_fingerprints(words), f"id {kind}, fp binary, shingles binary"), "near-fp")
    distinct = cut(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "near-distinct")
    n = distinct.count()
    found = cut(candidates(distinct, n, similarity, ends=True), "near-edges")
    links = _verified(fps, found.where("a <> b"), similarity)
    labels = components(links, "near-labels")
    # an edge of a forest may fail the check where a pair that the forest leaves out holds: those still apart are checked pair by pair
    again = found.where("a = b").select(F.col("a").alias("fp"))
    more = left_out_links(fps, again, labels, n, similarity)
    if not more.isEmpty():
        # the labels stand for the links: a row a node
        joined = components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(more), "near-labels")
        release(labels)
        labels = cut(joined, "near-named")
        release(joined)
    release(found, links, more)
    named = distinct.select("fp").join(labels.select(F.col("v").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    return fps.select("id", "fp"), named, [fps, distinct, labels]


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the smallest id (and of its rows the smallest fingerprint).

    Groups are told apart by their labels, as ids may be null or repeated.
    """
    fps, named, held = groups(docs, id_col, text_col, words, similarity)
    # copies are put together before anything is sent by fingerprint
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id")).alias("first"))
    least = first.join(named, "fp").groupBy("label").agg(F.min(F.struct("first.null", "first.id", "fp")).alias("least"))
    rows_of = fps.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    kept = least.select(F.col("least.id").alias("__id"), F.col("least.fp").alias("__fp"))
    kept = cut(kept.join(rows_of, F.col("__id").eqNullSafe(F.col("id"))).select("__id", "__fp", ((F.col("n") == 1) & F.col("__id").isNotNull()).alias("__alone")), "near-kept")
    release(*held)
    # as many ids as documents: a merge at every size
    alone = docs.join(kept.where("__alone").select("__id").hint("merge"), F.col(id_col) == F.col("__id")).select(*docs.columns)
    shared = kept.where("NOT __alone")
    if shared.isEmpty():
        return alone
    # ids that several rows have (or that are null): the text's fingerprint decides, worked out anew for these rows
    same = docs.join(shared.select("__id").distinct(), F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    marked = _with_fingerprint(same, text_col, words)
    taken = marked.join(shared, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp"))).dropDuplicates([id_col, "__own"])
    return alone.unionByName(taken.select(*docs.columns))


def _with_fingerprint(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    from pyspark.sql import types as T

    @F.arrow_udf(T.BinaryType())
    def own(raws: pa.Array) -> pa.Array:
        return pa.array([fingerprint(h) for at in range(0, len(raws), 256) for h in shingle_hashes([r or b"" for r in raws.slice(at, 256).to_pylist()], words)], pa.binary())

    return docs.withColumn("__own", own(raw_text(text_col)))
