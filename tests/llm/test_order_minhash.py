import hashlib

import numpy as np

from cairn.llm import order_minhash as o


def plain_entries(text):
    """The same fingerprint with dictionaries and sorting of Python numbers."""
    n = max(1, len(text) - o.K + 1)
    kmers = []
    for i in range(n):
        h = 0
        for c in text[i : i + o.K]:
            h = (h * int(o._ONE) + ord(c)) % (1 << 64)
        kmers.append(np.uint64((h + 1) % (1 << 64)))
    kmers = [int(x) for x in o._mix(np.array(kmers, np.uint64))]
    seen, pairs = {}, []
    for i, h in enumerate(kmers):
        k = seen[h >> 24] = seen.get(h >> 24, -1) + 1
        pairs.append(int(o._mix(np.array([(h + k * int(o._ONE)) % (1 << 64)], np.uint64))[0]) >> 32)
    out = []
    for xor, times in zip(o._XOR.ravel().tolist(), o._TIMES.ravel().tolist()):
        order = sorted(range(n), key=lambda i: (((pairs[i] ^ xor) * times) % (1 << 32), i))
        h = np.zeros(1, np.uint64)
        for i in sorted(order[: o.PICKED]):
            h = o._mix(h * o._ONE + np.array([kmers[i]], np.uint64))
        out.append((int(h[0]) >> 32) | 1)
    return out


def test_entries_match_brute_force():
    for text in ("a", "abcdefgh", "abcdefghi", "the cat sat on the mat, the cat sat on the mat", "naïve 漢字 text repeated " * 9, "long " * 900 + "x", " ".join(map(str, range(2500)))):
        assert o.entries(text).tolist() == plain_entries(text)


def test_order_and_edits_lower_the_likeness():
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    text, moved = " ".join(words), " ".join(words[200:] + words[:200])
    shuffled = " ".join(sorted(words))
    a = o.entries(text)
    assert o.likeness(a, o.entries(text)) == 1.0
    assert o.likeness(a, o.entries(text + " end")) > o.likeness(a, o.entries(moved)) > o.likeness(a, o.entries(shuffled))
    assert not o.entries("").any() and o.likeness(o.entries(""), a) == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_likeness_follows_the_edit_distance():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 900, 120)]
    text, near, far = " ".join(words), [], []
    for edits in (0, 2, 5, 10, 20, 40, 80):
        other = list(words)
        for at in rng.choice(120, edits, replace=False):
            other[at] = f"z{at}"
        far.append(edit_distance(text, " ".join(other)))
        near.append(o.likeness(o.entries(text), o.entries(" ".join(other))))
    assert far == sorted(far)
    ranks = np.argsort(np.argsort(near)[::-1])
    assert abs(np.corrcoef(ranks, np.arange(7))[0, 1]) > 0.9 and near[0] == 1 and near[-1] < 0.2


def test_null_and_repeated_ids_and_ids_of_text(spark):
    rows = [(None if i % 3 == 0 else f"id{i % 7}", f"text number {i % 20} " * 5) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id string, text string").repartition(6)
    keyed = table.selectExpr("doc_id", "text", "xxhash64(text) AS tie").collect()
    chain = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or "", r.tie, r.text))
    want = sorted((r.doc_id or "", len(r.text), hashlib.sha256(o.edited(r.text, chain[(i + 1) % 200].text).encode()).hexdigest()) for i, r in enumerate(chain))
    for size in (4 << 20, 700):
        got = sorted((r.id or "", r.n_chars, r.edited_sha256) for r in o.neighbours(table, range_bytes=size).collect())
        assert got == want


def test_neighbours_of_a_table(docs, empty):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want = []
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        f, e, g = o.entries(text), o.entries(new), o.entries(after)
        want.append((r.doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), o.as_text(f), o.as_text(e), o.likeness(f, e), o.likeness(f, g)))
    key = lambda t: (t[0] is not None, t[0] or 0, t[2])
    for size in (4 << 20, 600):  # one range, and several
        got = [tuple(r) for r in o.neighbours(docs, range_bytes=size).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert o.neighbours(empty).count() == 0
    single = [tuple(r)[-2:] for r in o.neighbours(docs.where("doc_id = 0")).collect()]
    assert len(single) == 1 and single[0][1] == 1.0
