"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of every 3-word shingle of the whole text, one
bit per position that more than half of the hashes set.  Two fingerprints link
at ``RADIUS`` or fewer differing bits; documents are grouped by connected
components of those links.

Candidates: 64 bits are cut into six blocks.  Two words that differ in at most
three bits agree on at least three whole blocks, so every link shows up under
one of the twenty keys made of three blocks.  Only distinct fingerprints are
keyed (copies are grouped first); a key with many members is dealt to
chunk-pair groups, so that no task gets an unbounded group and no link is lost.

Comparison: inside a group the fingerprints are held as 64 vertical bit planes.
Each plane's difference is added into carry-save counters (ones, twos, a sticky
overflow), 64 lanes per machine word, and blocks of lanes that have all passed
the radius are abandoned.

Defined cases: a null text counts as empty; an empty text has fingerprint zero
and links like any other; ``component_id`` is null only if every id of the
component is null; repeated rows are kept, each with the same component.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import cut, raw_text, release, spread_join, tidy, values

RADIUS = 3
SEED = 42
#: Widths of the six blocks of a fingerprint, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one chunk of a hot key; a group compares at most two chunks.
CHUNK = 2048
#: Groups up to this size are compared together, by distance in the list.
SMALL = 32
FAN = 8


def fingerprint_bytes(raw: bytes) -> int:
    """The fingerprint of one text given as UTF-8 bytes, unsigned."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        n = len(words) - 2
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    got = np.fromiter((fingerprint_bytes(t) for t in values(texts)), np.uint64, len(texts))
    tidy()
    return pa.array(got.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (signed view of the 64 bits) for every row."""
    return docs.select(F.col(id_col).alias("id"), _fingerprint(raw_text(text_col)).alias("fp"))


def key_masks() -> list[int]:
    """The twenty masks of three blocks each, as signed 64-bit values."""
    starts = np.cumsum((0, *BLOCKS[:-1]))
    one = [((1 << w) - 1) << int(s) for s, w in zip(starts, BLOCKS)]
    masks = [sum(one[i] for i in pick) for pick in combinations(range(len(one)), len(one) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _planes(words: np.ndarray) -> np.ndarray:
    """64 bit planes of ``words``, 64 lanes per uint64; absent lanes are zero."""
    lanes = -len(words) % 64
    bits = np.unpackbits(np.pad(words, (0, lanes)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    """The bits of a row of lane words as booleans."""
    return np.unpackbits(mask.view(np.uint8), bitorder="little")[:n].astype(bool)


def _add(planes, ones, twos, over):
    """Carry-save step: add one difference plane to 2-bit counters with a sticky overflow."""
    carry = ones & planes
    ones ^= planes
    over |= twos & carry
    twos ^= carry


def within(differences: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each XOR word, whether at most three bits are set; counted over vertical planes."""
    assert radius == 3, "the 2-bit counters overflow exactly beyond three"
    planes = _planes(differences)
    live = np.arange(planes.shape[1])
    ones = np.zeros(len(live), np.uint64)
    twos, over, out = ones.copy(), ones.copy(), np.full(len(live), ~np.uint64(0))
    for b in range(64):
        _add(planes[b, live], ones, twos, over)
        if b in (15, 23, 31, 47) and len(live) > 64:
            stay = over != ~np.uint64(0)
            if not stay.all():
                live, ones, twos, over = live[stay], ones[stay], twos[stay], over[stay]
    out[live] = over
    return ~_lanes(out, len(differences))


def neighbours(planes: np.ndarray, n: int, queries: np.ndarray):
    """For a block of queries against all lanes: the pairs (query index, lane) within the radius."""
    full = ~np.uint64(0)
    words = planes.shape[1]
    over_all = np.full((len(queries), words), full)
    qs, ws = np.divmod(np.arange(len(queries) * words), words)
    ones = np.zeros(len(qs), np.uint64)
    twos, over = ones.copy(), ones.copy()
    for b in range(64):
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        _add(planes[b][ws] ^ flip[qs], ones, twos, over)
        if b % 8 == 7 and b < 63:
            stay = over != full
            if stay.mean() < 0.8:
                qs, ws, ones, twos, over = qs[stay], ws[stay], ones[stay], twos[stay], over[stay]
    over_all[qs, ws] = over
    near = np.unpackbits((~over_all).view(np.uint8), axis=1, bitorder="little")[:, :n]
    return np.nonzero(near)


def _small_links(items: np.ndarray, group: np.ndarray):
    """Star edges of the components inside many small groups, laid side by side."""
    n = len(items)
    left, right = [], []
    for step in range(1, SMALL):
        if step >= n:
            break
        i = np.nonzero(group[step:] == group[:-step])[0]
        if not len(i):
            break
        i = i[within(items[i] ^ items[i + step])]
        left.append(i)
        right.append(i + step)
    if not left:
        return items[:0], items[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.nonzero(root != np.arange(n))[0]
    return items[moved], items[root[moved]]


def _large_links(items: np.ndarray):
    """Edges of a low-degree tree for each component of one large group (flood search)."""
    items = np.unique(items)
    n = len(items)
    planes = _planes(items)
    seen = np.zeros(n, bool)
    step = max(1, (1 << 21) // planes.shape[1] // 8)
    child, parent = [], []
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        members, front = [first], np.array([first])
        while len(front):
            found = np.zeros(n, bool)
            for at in range(0, len(front), step):
                found[neighbours(planes, n, items[front[at : at + step]])[1]] = True
            front = np.nonzero(found & ~seen)[0]
            seen[front] = True
            members.extend(front.tolist())
        m = items[np.sort(np.array(members))]
        k = np.arange(1, len(m))
        child.append(m[k])
        parent.append(m[(k - 1) // FAN])
    return np.concatenate(child), np.concatenate(parent)


def _edges(batches):
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum([len(x) for x in lists]) if len(lists) else np.zeros(0, int)
        sizes = np.diff(np.concatenate([[0], ends]))
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        a, b = _small_links(flat[small], group[small])
        pairs = [(a, b)]
        for g in np.nonzero(sizes > SMALL)[0]:
            pairs.append(_large_links(flat[ends[g] - sizes[g] : ends[g]]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of distinct ``fp`` within the radius."""
    keys = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(key_masks())])
        ).alias("key"),
    ).select("fp", "key.t", "key.k")
    hot = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    hot = hot.select("t", "k", F.ceil(F.col("n") / chunk).cast("int").alias("g"))
    # with g chunks, chunk c meets each chunk j in the group (least, greatest)
    c = F.pmod(F.xxhash64("fp"), F.coalesce("g", F.lit(1))).cast("int")
    dealt = keys.join(hot, ["t", "k"], "left").select("t", "k", "fp", c.alias("c"), F.coalesce("g", F.lit(1)).alias("g"))
    dealt = dealt.select("t", "k", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"))
    groups = (
        dealt.groupBy("t", "k", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )
    return groups.mapInArrow(_edges, "a long, b long").distinct()


def components(edges: DataFrame, label: str = "simhash-labels") -> DataFrame:
    """``v, label``: the smallest node reachable, by neighbour minima, pointer jumping and contraction.

    Every round hooks each node to its smallest neighbour, follows the hooks to
    their ends and puts the ends in the place of the nodes.  An end has a hooked
    neighbour, so that each round leaves at most half of a component's nodes: all
    rounds together join few more rows than there are edges and nodes.
    """
    edges = cut(edges.select("a", "b").distinct(), f"{label}-edges")
    names = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("v", "w")
        ends = _ends(cut(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")), label), label)
        named = cut(ends.select("v", "label") if names is None else _renamed(names, ends, "label"), label)
        # a finished component stays as a loop, so that every label has a name in the next round
        left = cut(_renamed(_renamed(edges, ends, "a"), ends, "b").distinct(), f"{label}-edges")
        release(edges, ends, *([] if names is None else [names]))
        if left.where("a <> b").isEmpty():
            release(left)
            return named
        edges, names = left, named


def _ends(at: DataFrame, label: str) -> DataFrame:
    """The ends of hooks ``v, label``, by pointer jumping (and ``moved``, then false)."""
    while True:
        # many nodes may have one label: it is looked up without sending them all to one task
        jump = spread_join(at.select("v", "label"), at.select(F.col("v").alias("label"), F.col("label").alias("next")), "label")
        new = cut(jump.select("v", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), label)
        release(at)
        if new.where("moved").isEmpty():
            return new
        at = new


def _renamed(rows: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    """``rows`` with the ends (``v, label``) of a column in its place."""
    named = spread_join(rows, ends.select(F.col("v").alias(column), F.col("label").alias("__end")), column)
    return named.select(*[F.col("__end").alias(column) if n == column else n for n in rows.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component`` for every row; ``component`` is the smallest id reachable."""
    fps = cut(fingerprints(docs, id_col, text_col), "simhash-fp")
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    edges = cut(links(distinct.select("fp")), "simhash-links")
    labels = components(edges)
    release(edges)
    named = distinct.join(labels, distinct.fp == labels.v, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = cut(named, "simhash-named")
    lowest = named.groupBy("label").agg(F.min("first").alias("component"))
    groups = cut(spread_join(named, lowest, "label").select("fp", "component"), "simhash-groups")
    release(distinct, named, labels)
    return spread_join(fps, groups, "fp").select("id", "fp", "component")
