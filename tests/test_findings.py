"""Queries on keys and orders that the smallest tables do not have, against their SQL."""

import duckdb
import pytest

from cairn.plans import catalogue


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    cols = ", ".join(f'"{c}"' for c in got.columns)
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, con.execute(f"SELECT {cols} FROM ({catalogue.ORACLE[name]})").fetchall()))


#: Keys whose numbers have a sign bit, 33 bits, 36 bits, and the bytes of a prologue.
CUSTOMERS = "SELECT unnest([0, 1, 21312, 32766, 32768, 65532, 65533, 65534, 86848, 899999])::BIGINT AS c_custkey"


@pytest.mark.parametrize("name", ["x86_code_index", "function_starts", "native_control_flow", "feature_coverage"])
def test_queries_of_code_hold_for_larger_keys(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, customer=CUSTOMERS)
    assert got == want and want


def test_fingerprints_of_code_whose_number_looks_like_a_prologue(spark, tmp_path):
    got, want = both(spark, tmp_path, "function_fingerprints", customer="SELECT unnest([0, 21312, 65535])::BIGINT AS c_custkey")
    assert got == want and len(want) == 6


def test_precedence_follows_the_texts_of_source_and_id(spark, tmp_path):
    documents = "SELECT * FROM (VALUES (3261, 'a', 'src1'), (590, 'a', 'src10'), (7, 'b', 'src2'), (900, 'b', 'src0'), (5, 'c', NULL), (6, 'c', 'src9'), (8, 'd', NULL)) t(doc_id, text, source)"
    got, want = both(spark, tmp_path, "universe_precedence", documents=documents)
    assert got == want and len(want) == 4


def test_best_candidates_are_those_of_the_join(spark):
    import random

    from cairn.operators import matching

    draw = random.Random(3)
    weights = {"strings": 4, "ngrams": 1}

    def side(n, first):
        rows = [(first + i, draw.choices([*"abcdefgh", None], k=draw.randrange(6)), [*{draw.randrange(40) for _ in range(draw.randrange(9))}]) for i in range(n)]
        return spark.createDataFrame([*rows, (first + n, None, [1, 2])], "key long, strings array<string>, ngrams array<long>")

    a, b = side(60, 0), side(300, 30)
    want = {tuple(r) for r in matching.candidates(a, b, weights=weights, keep=7).collect()}
    lean = matching._lean(a, "key", list(weights), "a")
    other = matching._lean(b, "key", list(weights), "b", matching._seen(lean, list(weights)))
    assert {tuple(r) for r in matching.best_candidates(lean, other, weights, keep=7).collect()} == want and len(want) > 300
    apart = matching.best_candidates(lean, other, weights, keep=1000, itself=False)
    assert {(r.a, r.b) for r in apart.collect()} == {(r[0], r[1]) for r in matching.candidates(a, b, weights=weights, keep=1000).collect() if r[0] != r[1]}


def test_meetings_are_counted_in_parts_of_whole_rows(monkeypatch):
    import pyarrow as pa

    from cairn.operators import matching

    lists = [[j for j in range(12) if (i * 7 + j * j) % 5 < 2] for i in range(40)]
    table = pa.table({"key": [*range(20), *range(20)], "h_ngrams": lists, "left": [i < 20 for i in range(40)]})
    whole = matching._meet({"ngrams": 1}, 5, True)(table).sort_by([("a", "ascending"), ("b", "ascending")])
    monkeypatch.setattr(matching, "MEETINGS", 50)
    assert matching._meet({"ngrams": 1}, 5, True)(table).sort_by([("a", "ascending"), ("b", "ascending")]) == whole and whole.num_rows


def test_control_flow_keeps_all_calls_bodies_and_bytes_of_a_function(spark):
    from cairn.plans import readers
    from cairn.sources import containers, native, tables

    call, dec, step, base = b"\xe8", b"\x48\xff\xc9", b"\x48\xff\xc9\x75\x00", 0x401000
    f = base + 5 * 12 + 1
    main = b"".join(call + (f - base - 5 * (i + 1)).to_bytes(4, "little") for i in range(12)) + b"\xc3"
    loop = step * 40 + b"\x0f\x85" + (-(5 * 40 + 6)).to_bytes(4, "little", signed=True)
    rest = dec * 24_000  # more than 65,536 bytes
    end = f + len(loop + rest)
    data = readers.code_file(main + loop + rest + call + (base - end - 5).to_bytes(4, "little", signed=True) + b"\xc3")
    rows = {int(r.va): r for r in tables.control_flow(spark.createDataFrame([("x", bytearray(data))], "sha256 string, content binary")).collect()}
    assert sorted(rows) == [base, f]
    assert [b["calls"] for b in rows[base].blocks] == [[f"{f:#x}"] * 12]
    got = rows[f]
    assert (got.insns, int(got.end), len(got.blocks), got.edges, got.complexity, got.single_exit) == (80 + 1 + 24_000 + 2, end + 6, 42, 82, 42, True)
    assert got.blocks[-1]["calls"] == [f"{base:#x}"] and got.blocks[-1]["insns"] == 24_002
    assert [(int(x["header"]), x["size"], [int(b) for b in x["body"]]) for x in got.loops] == [(f, 41, [f + 5 * i for i in range(41)])]
    image = containers.load(data)
    assert native.control_flow(image, data, f + 200, [base, f])["insns"] == 1 + 24_000 + 2


def test_starts_are_found_in_code_longer_than_an_index(monkeypatch):
    from cairn.plans import readers
    from cairn.sources import containers, native

    data = readers.caller(2)
    image = containers.load(data)
    want = native.function_starts(image, data)
    monkeypatch.setattr(native, "MOST_INSNS", 0)
    assert native.function_starts(image, data) == want and set(want.values()) == {"entry", "call"}


def test_control_flow_of_a_function_whose_first_byte_is_unknown():
    from cairn.plans import readers
    from cairn.sources import containers, native

    data = readers.code_file(b"\x06\x48\xff\xc9\x48\xff\xc9\x75\xfb\xc3")
    got = native.control_flow(containers.load(data), data, 0x401000, [0x401000])
    assert (got["function"], got["insns"], [b["start"] for b in got["blocks"]], [x["header"] for x in got["loops"]]) == (0x401000, 4, [0x401001, 0x401004, 0x401009], [0x401004])


def test_loops_are_those_of_dominator_sets():
    import random

    from cairn.operators import graph

    draw = random.Random(8)
    for _ in range(300):
        n = draw.randrange(1, 14)
        succ = {i: [*([i + 1] if i + 1 < n and draw.random() < 0.85 else []), *([draw.randrange(n)] if draw.random() < 0.6 else [])] for i in range(n)}
        doms = graph.dominator_sets(list(range(n)), succ, 0)
        found = graph.natural_loops(list(range(n)), succ, 0)
        assert sorted((x["tail"], x["header"]) for x in found) == sorted((t, h) for t in succ for h in succ[t] if h in doms[t])
        assert [x["depth"] for x in found] == [1 + sum(set(x["body"]) < set(y["body"]) for y in found) for x in found]
    # many ways back to one header, in a chain that sets of dominators would fill 200 million times
    n = 20_000
    found = graph.natural_loops(list(range(n)), {i: [*([i + 1] if i + 1 < n else []), *([i - 7] if i % 9 == 8 else [])] for i in range(n)}, 0)
    assert len(found) == n // 9 and {len(x["body"]) for x in found} == {8}
