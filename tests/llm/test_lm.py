import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import attention, lm, phrases


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_windows_score_each_id_once():
    for counts in ([1], [32], [33], [56, 57, 5], [1000]):
        counts = np.array(counts)
        starts, text, number = attention.cut_windows(counts)
        seen = np.zeros(counts.sum(), int)
        ends = np.cumsum(counts)
        for s, t, k in zip(starts, text, number):
            for place in range(0 if k == 0 else attention.WINDOW - attention.STRIDE, attention.WINDOW):
                if s + place < ends[t]:
                    seen[s + place] += 1
        assert (seen == 1).all()


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 300, 3000).astype(np.uint16)
    counts = np.array([700, 1, 40, 2259])
    seen = np.zeros(attention.VOCABULARY * 2 * attention.SPREAD, np.int64)
    np.add.at(seen, *attention.neighbour_cells(attention.id_pairs(ids, counts), np.ones(len(ids), np.int64)))
    model = attention.Model(attention.learn_classes(seen.reshape(attention.VOCABULARY, -1)))
    model.train(ids, counts, epochs=1)
    pairs = np.zeros((attention.CLASSES, attention.VOCABULARY))
    np.add.at(pairs, (model.classes[attention.inputs_of(ids, counts)], ids), 1)
    model.set_shares(pairs)
    return model.freeze(), ids, counts


def test_batched_scores_match_one_id_at_a_time(small_model):
    model, ids, counts = small_model
    got = model.scores(ids, counts)
    ends = np.cumsum(counts)
    for t in (1, 2):
        own = ids[ends[t] - counts[t] : ends[t]]
        x = np.concatenate([[attention.START], own[:-1]]).astype(int)
        total = 0.0
        for i, y in enumerate(own.astype(int)):
            k = 0 if i < attention.WINDOW else (i - attention.WINDOW) // attention.STRIDE + 1
            first = k * attention.STRIDE
            e = model.embed[x[first : i + 1]] + model.place[: i + 1 - first]
            s = (e @ model.key) @ (e[-1] @ model.query) * attention.DIM**-0.5
            att = np.exp(s - s.max())
            z = (att / att.sum()) @ (e @ model.value) @ model.from_past + model.embed[x[i]] @ model.from_last + model.bias
            z = z - z.max()
            total += (z[model.classes[y]] - np.log(np.exp(z).sum())) / math.log(10) + model.share[y, model.classes[x[i]]]
        assert math.isclose(got[t], total, rel_tol=1e-4)


def test_probabilities_add_up(small_model):
    model, _, _ = small_model
    totals = np.array([np.bincount(model.classes, weights=10.0 ** model.share[:, c], minlength=attention.CLASSES) for c in (0, 5)])
    used = np.bincount(model.classes, minlength=attention.CLASSES) > 0
    assert np.allclose(totals[:, used], 1, atol=1e-3)


def test_gradients_match_differences(small_model):
    model, ids, counts = small_model
    x, y = attention.inputs_of(ids, counts)[:64].reshape(2, 32), ids[:64].reshape(2, 32)
    valid = np.ones((2, 32), bool)
    valid[1, 20:] = False
    _, g, _ = model.gradients(x, y, valid)
    for name in attention.SMALL:
        table = getattr(model, name)
        at = np.unravel_index(np.argmax(np.abs(g[name])), table.shape)
        old, step = table[at], 1e-2
        table[at] = old + step
        up = model.gradients(x, y, valid)[0]
        table[at] = old - step
        down = model.gradients(x, y, valid)[0]
        table[at] = old
        assert math.isclose((up - down) / (2 * step), g[name][at], rel_tol=0.05, abs_tol=1e-5), name


def test_base_against_brute_force(docs, empty):
    train = ~F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    rows = docs.collect()
    counts = collections.Counter()
    for r in rows:
        if r.doc_id is None or r.doc_id % 3 != 1:
            counts.update(words(r.text))
    n, v = sum(counts.values()), len(counts)
    for size in (24 << 20, 4096):  # one bucket, and many
        got = collections.defaultdict(list)
        for r in lm.score(docs, train, bucket_bytes=size).collect():
            got[r.id].append(r)
        for r in rows:
            mine = words(r.text)
            want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine)
            for g in got[r.doc_id]:
                assert (g.n_tokens, g.n_known, g.train_tokens) == (len(mine), sum(counts[w] > 0 for w in mine), n)
                assert math.isclose(g.base_score, want, rel_tol=1e-9) and g.score < 0
        assert sum(map(len, got.values())) == len(rows) and len({g.score for g in got[8]}) == 1
    assert lm.score(empty, F.lit(True)).count() == 0
    alone = lm.score(docs.where("doc_id = 0"), F.lit(False)).first()
    assert alone.n_known == 0 and alone.train_tokens == 0 and alone.base_score == 0


def test_trained_model_beats_no_context(spark):
    rng = np.random.default_rng(5)
    chain = {a: b for a, b in zip("abcdefgh", "bcdefgha")}
    texts = []
    for _ in range(200):
        w, out = rng.choice(list(chain)), []
        for _ in range(60):
            out.append(w)
            w = chain[w]
        texts.append(" ".join(out))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm.score(table, F.col("doc_id") < 150).where("NOT train").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.3 * got[1]  # the next word follows from the last


def test_windows_overlap_by_half():
    counts = np.array([1000])
    starts, _, number = attention.cut_windows(counts)
    assert attention.STRIDE * 2 <= attention.WINDOW and lm.REFINE_EVERY <= 16


def plain_phrases(ids, order=phrases.ORDER):
    """Phrases of one text in plain loops: (context, phrase, start)."""
    n, starts = len(ids), []
    for t in range(order, n):
        a, b, c = (int(ids[t - k]) for k in (1, 2, 3))
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % (1 << 32)
        h ^= h >> 15
        if (h * 0x85EBCA77) % (1 << 32) >> 27 == 0:
            starts.append(t)
    out = []
    for t, end in zip(starts, [*starts[1:], n]):
        while t < end:
            out.append((tuple(ids[t - order : t].tolist()), tuple(ids[t : min(end, t + phrases.LONGEST)].tolist()), t))
            t += phrases.LONGEST
    return out


def test_phrases_are_cut_by_their_context():
    rng = np.random.default_rng(1)
    counts = np.array([1, 5, 400, 9, 3000, 30])
    ids = rng.integers(0, 50, counts.sum()).astype(np.uint16)
    text, start, end, context, phrase = phrases.cut_phrases(ids, counts)
    ends = np.cumsum(counts)
    want = [(t, s + ends[t] - counts[t], len(p)) for t in range(len(counts)) for c, p, s in plain_phrases(ids[ends[t] - counts[t] : ends[t]])]
    assert list(zip(text.tolist(), start.tolist(), (end - start).tolist())) == want and len(want) > 60
    whole = [(tuple(ids[s - 8 : s]), tuple(ids[s:e])) for s, e in zip(start, end)]
    assert len(set(zip(context.tolist(), phrase.tolist()))) == len(set(whole))


def test_scores_against_brute_force(spark, monkeypatch):
    """The whole score of a table: attention of every id, and the phrases that other training texts have."""
    monkeypatch.setattr(lm, "FIRST_IDS", 1000)
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary, 80))
    texts = [" ".join(rng.choice(vocabulary, 150)) + " " + (passage if i % 3 == 0 else "") + " " + " ".join(rng.choice(vocabulary, 40)) for i in range(60)]
    texts += texts[:10] + [None, "", passage, passage + " " + passage]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    train = F.col("doc_id") % 5 != 1
    fitted = lm.fit(table, train)
    got = {r.id: r.score for r in lm.score(table, train).collect()}
    from cairn.llm.tokens import encoded, vocabulary_path

    ids_of = {}
    for i, text in enumerate(texts):
        ((_, _, ids, counts),) = encoded([(text or "").encode()], vocabulary_path())
        ids_of[i] = ids
    held = collections.defaultdict(collections.Counter)
    for i, ids in ids_of.items():
        if i % 5 != 1:
            for c, p, _ in plain_phrases(ids):
                held[c][p] += 1
    checked = 0
    for i, ids in ids_of.items():
        lp = fitted.model.log_probs(ids, np.array([len(ids)])).astype(float)
        own = collections.Counter()
        parts = plain_phrases(ids)
        if i % 5 != 1:
            own.update((c, p) for c, p, _ in parts)
        _, _, _, keys, _ = phrases.cut_phrases(ids, np.array([len(ids)]))
        is_hot = lm.lookup(fitted.hot.contexts, keys) >= 0
        pair_hot = lm.lookup(fitted.hot.pairs, phrases.pair_keys(keys, phrases.cut_phrases(ids, np.array([len(ids)]))[4])) >= 0
        total = lp.sum()
        for (c, p, s), h, listed in zip(parts, is_hot, pair_hot):
            counts = held[c].copy()
            for (x, q), k in own.items():
                if x == c:
                    counts[q] -= k
            n = sum(counts.values())
            if not n:
                continue
            prob = 10 ** lp[s : s + len(p)].sum()
            if not h:
                kinds = sum(v > 0 for v in counts.values())
                mixed = kinds / (n + kinds) * prob + counts[p] / (n + kinds)
            else:
                often = {q for q, k in held[c].items() if k >= lm.OFTEN}
                kinds = len(often) + 1
                mixed = (n - sum(counts[q] for q in often) + kinds) / (n + kinds) * prob + (counts[p] / (n + kinds) if listed else 0)
                assert listed == (p in often)
            total += math.log10(mixed) - math.log10(prob)
            checked += 1
        assert math.isclose(got[i], total, rel_tol=2e-4, abs_tol=1e-3), i
    assert checked > 100
    # a text with another copy is told apart from the others of its fold
    per = {i: got[i] / len(ids_of[i]) for i in range(60) if i % 3}
    assert min(v for i, v in per.items() if i < 10 and i % 5 != 1) > max(v for i, v in per.items() if i >= 10)


def test_probabilities_of_phrases_add_up():
    counts = np.array([5, 3, 1])
    log_prob = np.log10([0.01, 0.02, 0.5])
    mixed = 10 ** (log_prob + phrases.gains(log_prob, np.full(3, 9), counts, np.full(3, 3)))
    rest = 3 / 12 * (1 - 0.53)  # phrases that the corpus has not seen here
    assert math.isclose(mixed.sum() + rest, 1)


def test_lookup_finds_what_is_there():
    rng = np.random.default_rng(8)
    table = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    keys = np.concatenate([rng.choice(table, 300), rng.integers(0, 1 << 62, 300).astype(np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    place = {int(k): i for i, k in enumerate(table)}
    assert lm.lookup(table, keys).tolist() == [place.get(int(k), -1) for k in keys]
    assert lm.lookup(table[:0], keys[:3]).tolist() == [-1] * 3 and lm.lookup(table[:1], table[:2]).tolist() == [0, -1]


def test_counters_against_plain_counts():
    rng = np.random.default_rng(9)
    counts = np.array([300, 1, 200])
    ids = rng.integers(0, 40, 501).astype(np.uint16)
    size = attention.VOCABULARY * 2 * attention.SPREAD
    got, want = lm.Counters(size + 10), np.zeros(size + 10, np.int64)
    for _ in range(2):
        got.add_neighbours(attention.id_pairs(ids, counts))
        got.add(size + rng.integers(0, 10, 50) * 0 + 3)
    ends = np.cumsum(counts)
    for t in range(3):
        own = ids[ends[t] - counts[t] : ends[t]].tolist()
        for before, y in zip([attention.START, *own], own):
            want[y * 2 * attention.SPREAD + attention.BUCKET[before]] += 2
            if before != attention.START:
                want[before * 2 * attention.SPREAD + attention.SPREAD + attention.BUCKET[y]] += 2
    want[size + 3] = 100
    assert np.array_equal(got.flush(), want)


def test_binary_values_as_numbers():
    import pyarrow as pa

    values = [np.arange(n, dtype=np.uint16).tobytes() for n in (3, 0, 5)]
    for column in (pa.chunked_array([pa.array(values[:1], pa.binary()), pa.array(values[1:], pa.binary())]), pa.chunked_array([pa.array([b"xx", *values], pa.binary()).slice(1)]), pa.array(values, pa.large_binary())):
        flat, lengths = lm._flat(column, np.uint16)
        assert flat.tolist() == [0, 1, 2, 0, 1, 2, 3, 4] and lengths.tolist() == [3, 0, 5]
    assert [len(x) for x in lm._flat(pa.chunked_array([], pa.binary()), np.uint64)] == [0, 0]


def test_frequent_keys_follow_from_all_partitions():
    import pyarrow as pa

    rng = np.random.default_rng(12)
    keys = phrases.mix(rng.zipf(1.3, 6000).astype(np.uint64) % np.uint64(900))
    context, phrase = phrases.mix(rng.zipf(1.5, 3000).astype(np.uint64) % np.uint64(90)), rng.integers(0, 3, 3000).astype(np.uint32)
    least, rows = 20.0, collections.defaultdict(list)
    for share, w, p in ((0.1, slice(0, 600), slice(0, 300)), (0.5, slice(600, 3600), slice(300, 1800)), (0.4, slice(3600, 6000), slice(1800, 3000))):
        words = lm.Tally()
        for part in np.array_split(keys[w], 7):
            words.add(part)
            words.flush()
        for key, data in lm._named(words, [context[p]], [phrase[p]], least * share):
            rows[key].append(data)
    merged = [(k, lm._frequent(least)(pa.table({"key": pa.array([k] * len(v)), "data": pa.array(v, pa.binary())})).column("data")[0].as_py()) for k, v in rows.items()]
    hot = lm.Hot.of([(k // lm.SLICES, *lm._named_of(d)) for k, d in merged])
    pair = phrases.pair_keys(context, phrase)
    for got, flat in ((hot.words, keys), (hot.contexts, context), (hot.pairs, pair)):
        found, n = np.unique(flat, return_counts=True)
        assert set(found[n >= 2 * least].tolist()) <= set(got.tolist()) <= set(found[n >= least].tolist()) and (np.diff(got.astype(object)) > 0).all()
    owner = dict(zip(pair.tolist(), context.tolist()))
    assert [owner[k] for k in hot.pairs.tolist()] == hot.contexts[hot.context_of].tolist()
    assert 5 < len(hot.pairs) < len(set(pair.tolist()))


def test_every_training_text_trains_the_network(monkeypatch, small_model):
    """The rounds of a corpus that is gone through once take every id exactly once."""
    import types

    import pyarrow as pa

    model, _, _ = small_model
    rng = np.random.default_rng(13)
    values = [rng.integers(0, 300, n).astype(np.uint16) for n in (40, 3, 900, 1, 77, 200)]
    none = np.zeros(0, np.uint64)
    shared = types.SimpleNamespace(value=(model, lm.Hot(none, none, none, none.astype(np.int64))))
    monkeypatch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    weights, counted = np.zeros(attention.VOCABULARY), 0
    for turn in range(lm.ROUNDS):
        batch = pa.RecordBatch.from_arrays([pa.array([i % lm.ROUNDS for i in range(6)]), pa.array([v.tobytes() for v in values], pa.binary()), pa.array([b""] * 6, pa.binary())], names=["turn", "ids", "words"])
        for out in lm._train(shared, turn, 1, False)(iter([batch])):
            for data, vector in zip(out.column("data").to_pylist(), out.column("vector").to_pylist()):
                counted += int(np.frombuffer(data, "<i8", len(data) // 12, 4 * (len(data) // 12)).sum()) if data else 0
                number, rows = lm._rows_of(vector) if vector else (np.zeros(0, int), np.zeros((0, lm.WIDE)))
                weights[number[number < attention.VOCABULARY]] += rows[number < attention.VOCABULARY, -1]
    want = np.bincount(np.concatenate([attention.inputs_of(v, np.array([len(v)])) for v in values]), minlength=attention.VOCABULARY)
    assert np.array_equal(weights, want) and counted == sum(map(len, values))


def test_gradients_in_parts_are_those_of_the_whole(small_model):
    model, ids, counts = small_model
    x, y = attention.inputs_of(ids, counts)[:2240].reshape(70, 32), ids[:2240].reshape(70, 32)
    valid = np.random.default_rng(3).random((70, 32)) < 0.8
    (loss, g, de), (want, h, dh) = model._gradients_in_parts(x, y, valid), model.gradients(x, y, valid)
    assert math.isclose(loss, want, rel_tol=1e-4) and np.allclose(de, dh, atol=1e-6)
    assert all(np.allclose(g[n], h[n], atol=1e-5) for n in attention.SMALL)


def test_gradients_are_those_of_separate_products(small_model):
    """Loss and gradients of the joined tables against the softmax worked out table by table."""
    model, ids, counts = small_model
    x, y = attention.inputs_of(ids, counts)[:640].reshape(20, 32), ids[:640].reshape(20, 32)
    valid = np.random.default_rng(5).random((20, 32)) < 0.7
    e = (model.embed[x] + model.place).astype(float)
    s = np.einsum("wid,wjd->wij", e @ model.query, e @ model.key) * attention.DIM**-0.5
    s = np.where(np.tril(np.ones((32, 32), bool)), s, -np.inf)
    att = np.exp(s - s.max(axis=2, keepdims=True))
    a = (att / att.sum(axis=2, keepdims=True)) @ (e @ model.value)
    z = a @ model.from_past + model.embed[x] @ model.from_last + model.bias
    p = np.exp(z - z.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    hit = np.eye(attention.CLASSES)[model.classes[y]]
    for total in (None, 2 * valid.sum()):
        weight = valid / (total or valid.sum())
        loss, g, _ = model.gradients(x, y, valid, total)
        d = (p - hit) * weight[..., None]
        assert math.isclose(loss, -(np.log((p * hit).sum(axis=2)) * weight).sum(), rel_tol=1e-4)
        assert np.allclose(g["from_past"], np.einsum("wid,wic->dc", a, d), atol=1e-5)
        assert np.allclose(g["from_last"], np.einsum("wid,wic->dc", model.embed[x], d), atol=1e-5)
        assert np.allclose(g["bias"], d.sum(axis=(0, 1)), atol=1e-5)


@pytest.mark.parametrize("shift", [0, 150, -150])
def test_far_values_change_neither_gradients_nor_scores(small_model, shift):
    """A softmax is the same with any number added to all classes, also where the exponentials leave single precision."""
    model, ids, counts = small_model
    moved = model.copy()
    moved.bias = moved.bias + np.float32(shift)
    x, y = attention.inputs_of(ids, counts)[:224].reshape(7, 32), ids[:224].reshape(7, 32)
    valid = np.ones((7, 32), bool)
    (loss, g, de), (want, h, dh) = moved.gradients(x, y, valid), model.gradients(x, y, valid)
    assert math.isclose(loss, want, rel_tol=1e-4) and np.allclose(de, dh, atol=1e-5)
    assert all(np.allclose(g[n], h[n], atol=1e-4) for n in attention.SMALL)
    assert np.allclose(moved.log_probs(ids, counts), model.log_probs(ids, counts), atol=1e-4)


def test_sums_by_id():
    rng = np.random.default_rng(6)
    ids, rows = rng.integers(0, 90, 700).astype(np.uint16) * 500, rng.normal(size=(700, attention.DIM)).astype(np.float32)
    want = np.zeros((attention.VOCABULARY, attention.DIM))
    np.add.at(want, ids, rows)
    who, got = attention.sums_by_id(ids, rows)
    assert np.array_equal(who, np.unique(ids)) and np.allclose(got, want[who], atol=1e-4)
