import random

import numpy as np
import xxhash

from cairn.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius=3):
    """Brute force: smallest index reachable by links at most ``radius`` bits long."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def family(seed, n, spread):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(spread):
            x = base
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            out.append(x)
    return list(dict.fromkeys(out))


def test_within_counts_bits():
    rng = random.Random(1)
    words = [sum(1 << b for b in rng.sample(range(64), k)) for k in range(12) for _ in range(70)]
    assert simhash.within(np.array(words, np.uint64)).tolist() == [bin(w).count("1") <= 3 for w in words]


def test_every_near_pair_shares_a_key():
    masks = [m % (1 << 64) for m in simhash.key_masks()]
    rng = random.Random(2)
    for _ in range(500):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & flip == 0 for m in masks)


def test_small_and_large_groups_give_the_same_components(spark):
    fps = family(3, 12, 9) + family(4, 1, 400)
    want = groups(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for chunk in (2048, 40):  # the second deals hot keys to chunk pairs
        got = {r.v: r.label for r in simhash.components(simhash.links(table, chunk)).collect()}
        label = [got.get(x, x) for x in signed]
        for i in range(len(fps)):
            assert label[i] == label[want[i]]
        assert len(set(label)) == len(set(want))


def test_table_against_brute_force(docs):
    rows = docs.collect()
    got = {(r.id, r.fp): r.component for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(r.text) for r in rows]
    group = groups(fps)
    for i, r in enumerate(rows):
        members = [rows[j].doc_id for j in range(len(rows)) if group[j] == group[i] and rows[j].doc_id is not None]
        signed = fps[i] - (1 << 64) if fps[i] >> 63 else fps[i]
        assert got[r.doc_id, signed] == min(members, default=None)


def test_copies_of_one_text_are_no_hot_key(spark):
    rows = [(i, "one text that a third of all rows have" if i % 3 == 0 else f"text number {i * 7919} of its own {i}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = simhash.near_duplicates(table)
    found = {r.id: r.component for r in got.collect()}
    assert len(found) == 3000 and {found[i] for i in range(0, 3000, 3)} == {0}
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_components_join_few_more_rows_than_edges(spark, monkeypatch):
    """A clique, a sorted path, a star and a loop: edges are joined once, and what a round leaves of them after it."""
    rng = random.Random(6)
    edges = [(i, j) for i in range(60) for j in range(i)] + [(100 + i, 101 + i) for i in range(80)] + [(300 + i, 299) for i in range(1, 90)] + [(500, 500)]
    names = {v: rng.getrandbits(40) if v < 100 or v > 200 else v for e in edges for v in e}
    edges = [(names[a], names[b]) for a, b in edges]
    edges += [(b, a) for a, b in edges[::7]] + edges[::11]
    joined, real = [], simhash.cut

    def cut(df, label):
        out = real(df, label)
        if label.endswith("-edges"):
            joined.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    got = {r.v: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parts = [range(60), range(100, 181), range(299, 390), [500]]
    want = {names[v]: min(names[w] for w in part if w in names) for part in parts for v in part if v in names}
    assert got == want and len(joined) <= 5
    assert sum(joined) < 1.2 * len(set(edges))
