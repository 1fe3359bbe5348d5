import pytest

from cairn.llm import mixing


def brute(weights, blocks, period):
    """Slots by the same rule in plain loops: largest remainders at the limits, earliest deadlines inside."""
    total, n, out = sum(weights), len(weights), {}

    def placed(t):
        low = [t * w // total for w in weights]
        for i in sorted(range(n), key=lambda i: (-(t * weights[i] % total), i))[: t - sum(low)]:
            low[i] += 1
        return low

    last = max((-(-b * total // w) for b, w in zip(blocks, weights)), default=0)
    for k in range(-(-last // period)):
        first, then = placed(k * period), placed((k + 1) * period)
        left = sorted((-(-(b + 1) * total // weights[i]), i, b, b * total // weights[i]) for i in range(n) for b in range(first[i], min(then[i], blocks[i])))
        for s in range(period):
            free = [x for x in left if x[3] <= k * period + s]
            if free or left and period - s <= len(left):
                x = free[0] if free else min(left, key=lambda x: (x[3], x[0], x[1], x[2]))
                left.remove(x)
                out[x[1], x[2]] = (k * period + s, x[3], x[0])
    return out


@pytest.mark.parametrize("weights", [[1], [5, 1], [36, *[3] * 19], [1, 2, 3, 5, 8, 13], [1000, 1, 1], [333_331, *range(1000, 40_000, 2000)]])
def test_less_than_one_block_from_the_target_at_every_slot(spark, weights):
    slots, period = 480, 48
    total = sum(weights)
    blocks = [slots * w // total + 2 for w in weights]
    got = mixing.schedule(spark, weights, blocks, period).collect()
    assert {(r["rank"], r.block): (r.slot, r.release, r.deadline) for r in got} == brute(weights, blocks, max(period, 4 * len(weights)))
    by_slot = {r.slot: r["rank"] for r in got}
    assert len(by_slot) == len(got) == sum(blocks)
    done = [0] * len(weights)
    for t in range(slots):  # no source has run out before that
        done[by_slot[t]] += 1
        assert all(abs(done[i] * total - (t + 1) * w) < total for i, w in enumerate(weights))


def test_places_of_a_table(spark, docs, empty):
    rows = [(i, f"s{min(i % 7, 3)}", "t") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for data in (table, docs):
        got = mixing.places(data, block_rows=4).collect()
        found = data.select("doc_id", "source").collect()
        counts, keys = {}, {}
        for r in found:
            counts[r.source] = counts.get(r.source, 0) + 1
            keys.setdefault(r.source, set()).add(r.doc_id)
        order = sorted(counts, key=lambda s: (-counts[s], s is not None, s or ""))
        weights = [int(counts[s] ** 0.5 * mixing.SCALE) for s in order]
        slots = brute(weights, [-(-len(keys[s]) // 4) for s in order], mixing.PERIOD)
        want = {}
        for i, s in enumerate(order):
            for n, ident in enumerate(sorted(keys[s], key=lambda x: (x is not None, x or 0))):
                want[ident, s] = (n // 4, slots[i, n // 4][0], n % 4)
        assert {(r.id, r.source): (r.block, r.slot, r.place) for r in got} == want
        assert sum(r.n for r in got) == len(found)
    assert mixing.places(empty).count() == 0


def test_given_weights_and_order(spark):
    table = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(400)], "doc_id long, source string, x long")
    mixed = mixing.mix(table, weights={"a": 3, "b": 1}, block_rows=1, period=8)
    assert mixed.columns == table.columns
    head = [r.source for r in mixed.limit(200).collect()]
    assert all(abs(head[:k].count("a") - 0.75 * k) < 1 for k in range(1, 200))
    assert mixed.count() == 400


def test_sources_without_weight_follow_and_none_shares_a_place(spark):
    table = spark.createDataFrame([(i, f"s{i % 10}" if i % 10 else None) for i in range(500)], "doc_id long, source string")
    got = mixing.places(table, weights={"s1": 0.5, "s2": 0.25}, block_rows=2).collect()
    assert len(got) == 500 and len({(r.slot, r.place) for r in got}) == 500
    last = max(r.slot for r in got if r.source in ("s1", "s2"))
    assert all(r.slot > last for r in got if r.source not in ("s1", "s2"))
    assert len({r.source for r in mixing.places(table, block_rows=2).collect()}) == 10
    assert mixing.places(table, weights={}).count() == 500
    with pytest.raises(ValueError):
        mixing.places(table, weights={"s1": -1})


def test_whole_weights():
    assert mixing.whole_weights([0.5, 0.25, 0]) == [2, 1, 0] and mixing.whole_weights([3, 1]) == [3, 1]
    assert mixing.whole_weights([1 / 3, 2 / 3]) == [1, 2]
    big = mixing.whole_weights([0.123456789, 0.777777777, 3.14159265358979])
    assert abs(big[0] / big[2] - 0.123456789 / 3.14159265358979) < 1e-5


def test_equal_keys_have_an_order_of_their_own(spark):
    table = spark.createDataFrame([(1, "a", f"text {i}") for i in range(50)], "doc_id long, source string, text string")
    once = [r.text for r in mixing.mix(table.repartition(3)).collect()]
    assert once == [r.text for r in mixing.mix(table.repartition(7)).collect()] and len(once) == 50


def test_no_python_on_the_executors(spark, docs):
    plan = mixing.places(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan.split("InMemory")[0]
