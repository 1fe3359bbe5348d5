import random

import numpy as np
import pytest

from cairn.llm import near_texts as t


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def made(seed, n, size=120):
    """Texts in families: edits of some words of a base text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(base)
            for at in rng.sample(range(size), rng.choice([0, 1, 1, 2, 8, 30])):
                other[at] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    return texts[:n]


def classes(texts, similarity=t.SIMILARITY):
    sets = [shingles(x) for x in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_planes_and_counters_count_exactly():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 256, (400, 32)).astype(np.uint8)
    fps[100:200] = fps[:100] ^ (rng.random((100, 32)) < 0.2).astype(np.uint8) * 17
    group = np.sort(rng.integers(0, 12, 400))
    words = fps.view(np.uint64)
    for radius in (0, 3, 20, 62, 118, 127):
        a, b = t.close_pairs(fps, group, radius)
        want = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and int(np.bitwise_count(words[i] ^ words[j]).sum()) <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_spanning_forest_is_shortest():
    a, b, d = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([5, 1, 2, 9])
    assert sorted(t.spanning(a, b, d).tolist()) == [1, 2, 3]


def test_shape_of_tables():
    assert t.table_shape(10)[0] == 16 and t.table_shape(1 << 30)[0] == 28
    bits, tables = t.table_shape(1000)
    assert 1 - (1 - 0.848**bits) ** tables > 0.98


def test_representatives_against_brute_force(spark):
    texts = made(5, 500)
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = set(classes(texts))
    got = {r.doc_id for r in t.representatives(table).collect()}
    assert len(want) < 450
    # the search may miss a pair at the very limit, and never joins others
    assert want <= got and len(got - want) <= 0.02 * (500 - len(want))


def test_a_large_group_of_copies_and_near_copies(spark):
    base = made(8, 1, 200)[0].split()
    rows = []
    for i in range(900):
        words = list(base)
        if i % 2:
            words[i % 200] = f"w{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, x) for i, x in enumerate(made(9, 60, 90)[:1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (t.CHUNK, 50):
        fps = table.selectExpr("doc_id AS id", "CAST(text AS BINARY) AS raw").mapInArrow(t._fingerprints(5), "id long, fp binary, shingles binary").select("fp").distinct()
        edges = t.candidates(fps, 450, chunk=chunk)
        assert edges.count() < 64 * 450 * 3
    assert sorted(r.doc_id for r in t.representatives(table).collect()) == [0, 1000]


def test_odd_rows(docs, empty):
    kept = t.representatives(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum(r.doc_id == 8 for r in rows) == 1 and {0} == {r.doc_id for r in rows} & {0, 1}
    assert sum(not (r.text or "").split() for r in rows) == 1
    assert t.representatives(empty).count() == 0


def test_null_and_repeated_ids(spark):
    texts = ["red apples grow on old trees in autumn", "my train was late again this monday morning", "numbers and figures fill the quarterly report", "a fox sleeps under the wooden bridge"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, texts[2])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = t.representatives(table).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3])])


@pytest.mark.parametrize("text", ["", "one", "one two three four", "a b c d e", "a b c d e f"])
def test_shingles_of_short_texts(text):
    (found,) = t.shingle_hashes([text.encode()])
    assert len(found) == len(shingles(text))
    assert (t.fingerprint(found) == bytes(32)) == (not text)


def test_without_broadcasts_the_result_is_the_same(spark, monkeypatch):
    texts = made(11, 160)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(r.doc_id for r in t.representatives(table).collect())
    monkeypatch.setattr(t, "MOST_HOT", -1)
    assert sorted(r.doc_id for r in t.representatives(table).collect()) == want


def test_a_pair_that_the_forest_leaves_out_is_checked():
    import pyarrow as pa

    fps = np.zeros((3, 32), np.uint8)
    fps[1, 0], fps[2, 0] = 1, 3  # at distances 1, 1 and 2: the forest leaves out the first and the last
    row = lambda labels: [[{"fp": f.tobytes(), **({"label": x} if x else {})} for f, x in zip(fps, labels)]]
    batch = lambda labels: iter([pa.RecordBatch.from_arrays([pa.array(row(labels))], names=["fps"])])
    pairs = lambda made: {tuple(r.values()) for b in made for r in b.to_pylist()}
    one, two, three = (f.tobytes() for f in fps)
    assert pairs(t._edges(t.RADIUS)(batch([None] * 3))) == {(one, two), (two, three), (one, one), (three, three)}
    assert pairs(t._edges(t.RADIUS, True)(batch([b"x", b"y", b"z"]))) == {(one, two), (two, three), (one, three)}
    assert pairs(t._edges(t.RADIUS, True)(batch([b"x", b"x", b"z"]))) == {(one, three), (two, three)}
    assert not pairs(t._edges(t.RADIUS, True)(batch([b"x"] * 3)))


def test_left_out_pairs_of_a_large_group_are_checked_in_their_group(spark):
    """Links of near copies, many of them below the limit: all that pairs give, in no more rows than there are labels."""
    rng = random.Random(4)
    base, n = made(12, 1, 150)[0].split(), 240
    texts = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"w{i}x{at}"
        texts.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(texts)), "id long, raw string").selectExpr("id", "CAST(raw AS BINARY) AS raw")
    fps = table.mapInArrow(t._fingerprints(5), "id long, fp binary, shingles binary").cache()
    rows = fps.orderBy("id").collect()
    numbers, sets = {r.fp: i for i, r in enumerate(rows)}, [shingles(x) for x in texts]
    words = np.array([np.frombuffer(r.fp, np.uint64) for r in rows])
    bits, tables = t.table_shape(n)
    spread = np.array([np.unpackbits(np.frombuffer(r.fp, np.uint8), bitorder="little") for r in rows])
    picks = t._picks(bits, tables)

    def wanted(pairs):
        root = list(range(n))
        for i, j in pairs:
            root = [root[i] if r == root[j] else r for r in root]
        return root

    links = [
        (i, j)
        for i in range(n)
        for j in range(i)
        if jaccard(sets[i], sets[j]) >= t.SIMILARITY and np.bitwise_count(words[i] ^ words[j]).sum() <= t.RADIUS and any((spread[i, p] == spread[j, p]).all() for p in picks)
    ]
    same = lambda a, b: len(set(a)) == len(set(b)) == len(set(zip(a, b)))
    none = spark.createDataFrame([], "v binary, label binary")
    for chunk in (t.CHUNK, 37):
        got = t.left_out_links(fps, fps.select("fp").distinct(), none, n, chunk=chunk).collect()
        assert all(jaccard(sets[numbers[r.a]], sets[numbers[r.b]]) >= t.SIMILARITY for r in got)
        assert same(wanted([(numbers[r.a], numbers[r.b]) for r in got]), wanted(links))
    picked = np.packbits(np.isin(np.arange(t.BITS), picks[0])[None], axis=1, bitorder="little").view(np.uint64)
    found = t.group_links(0, words.view(np.uint8), np.zeros(n, int), np.arange(n), [np.frombuffer(r.shingles, "<u4") for r in rows], picked, t.RADIUS, t.SIMILARITY)
    assert len(found) < n < len(links) / 10
