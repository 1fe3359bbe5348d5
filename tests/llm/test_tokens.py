import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cairn.llm import packing, rans, tokens
from cairn.llm.common import shared_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [tokens.END]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_units_match_the_library_on_odd_texts(library):
    rng = random.Random(7)
    letters = "ab'stre dlmv,.!#\n\t 019éÉñüßİ×—́<|>\x1c漢"
    texts = ["", "don't stop 'tis ,'s O'Neil's", "<|endoftext|> a", "É éà— , a—,b İ, ŉ ſ", "\x01 \x02a", "x" * 3000]
    texts += ["".join(rng.choice(letters[: rng.choice([20, 30, len(letters)])]) for _ in range(rng.choice([3, 40, 200]))) for _ in range(400)]
    raws = [t.encode() for t in texts]
    for _ in range(2):  # cold, then remembered
        for i, j, ids, counts in tokens.encoded(raws, tokens.vocabulary_path()):
            ends = np.cumsum(counts)
            for k in range(i, j):
                assert ids[ends[k - i] - counts[k - i] : ends[k - i]].tolist() == whole(library, texts[k]), texts[k]


def test_long_texts_are_cut_at_white_space(library):
    text = "alpha beta, gamma! " * 80_000
    ((_, _, ids, counts),) = tokens.encoded([text.encode()], tokens.vocabulary_path())
    assert counts[0] == len(ids) and ids[:100].tolist() == whole(library, text[:400])[:100]
    assert len(ids) == 80_000 * len(library.encode("alpha beta, gamma!", add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.BLOCK, 3 * rans.BLOCK + 17])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_000).astype(np.uint16)
    table = rans.Table(np.bincount(ids, minlength=1 << 16))
    data = rans.encode_file(ids, [3, None], np.array([n - 0, 0]), rans.Table.read(table.data))
    got, docs, counts = rans.decode_file(data, table)
    assert np.array_equal(got, ids) and docs == [3, None] and counts.tolist() == [n, 0]
    last = (n - 1) // rans.BLOCK  # a checkpoint allows one block alone
    alone, _, _ = rans.decode_file(data, table, range(last, last + 1))
    assert np.array_equal(alone, ids[last * rans.BLOCK :])


def test_frequencies_fill_the_table():
    for counts in ({0: 1}, {5: 10**12, 6: 1}, {i: 1 for i in range(49_408)}, {i: i + 1 for i in range(3000)}):
        dense = np.zeros(1 << 16, np.int64)
        dense[list(counts)] = list(counts.values())
        table = rans.Table(dense)
        assert int(table.freq.sum()) == 1 << rans.PRECISION and (table.freq[dense > 0] > 0).all()


def test_damage_is_noticed():
    ids = np.arange(1000, dtype=np.uint16)
    table = rans.Table(np.bincount(ids, minlength=1 << 16))
    data = bytearray(rans.encode_file(ids, [1], np.array([1000]), table))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_file(bytes(data), table)


def test_token_files_of_a_table(docs, empty, library, spark):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(rans.round_trip(docs).collect(), key=lambda r: r.start)
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = whole(library, r.text)
        assert (g.id, g.start, g.n, g.crc) == (r.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert rans.round_trip(empty).count() == 0
    held = tokens.tokenize(docs.selectExpr("doc_id AS id", "text"), ["id"])
    path = shared_path(spark, "test-files")
    rans.write_files(held, path, file_ids=5000)  # several files
    read = rans.read_files(spark, path)
    assert read.select("place").distinct().count() > 1
    assert sorted((x.id or -1, bytes(x.ids)) for x in read.collect()) == sorted((r.doc_id or -1, np.array(whole(library, r.text), "<u4").tobytes()) for r in rows)


def check_packing(pieces, rows, library, window=packing.WINDOW):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence, []).append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    for p in pieces:
        by_doc.setdefault(p.id, []).append(p)
    for r in rows:
        if [x.doc_id for x in rows].count(r.doc_id) > 1:
            continue
        ids, at = whole(library, r.text), 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)


def test_packing_of_a_table(docs, empty, library):
    rows = docs.collect()
    pieces = packing.pack(docs, whole=False).collect()
    check_packing(pieces, rows, library)
    assert sum(p.length for p in pieces) == sum(len(whole(library, r.text)) for r in rows)
    assert packing.pack(empty).count() == 0


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(40):
        window = 16
        at = np.array(sorted({0, *rng.sample(range(1, 60), 25), 60, *range(0, 60, 10)}))
        penalty = np.array([0, *(rng.choice([0, 3, 9]) for _ in at[1:-1]), 0])

        def cost(i, j):
            n = int(at[j] - at[i])
            pad = 0 if n & (n - 1) == 0 else window - n
            return pad + int(penalty[j]) + packing.PER_SEQUENCE if n <= window else 10**9

        best = [0] * len(at)
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(i, j) for i in range(j))
        cuts = [int(np.searchsorted(at, c)) for c in packing.best_cuts(at, penalty, window)]
        assert sum(cost(i, j) for i, j in zip(cuts, cuts[1:])) == best[-1]


def test_any_id_type_and_repeated_ids(spark, library):
    rows = [(None if i % 3 == 0 else f"n°{i % 9}", f"text {i % 25} " * (1 + i % 4)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    held = tokens.tokenize(table.selectExpr("doc_id AS id", "text"), ["id"])
    for number, kind in enumerate(("string", "decimal(9,2)", "bigint")):
        typed = table if kind == "string" else table.selectExpr(f"CAST(regexp_extract(doc_id, '[0-9]+', 0) AS {kind}) AS doc_id", "text")
        got = rans.round_trip(typed)
        assert got.schema["id"].dataType.simpleString() == kind
        ordered = sorted(got.collect(), key=lambda r: r.start)
        assert [r.start for r in ordered] == [sum(x.n for x in ordered[:i]) for i in range(300)]
        keys = [(r.id is not None, r.id or 0) if kind != "string" else (r.id is not None, r.id or "") for r in ordered]
        assert keys == sorted(keys)
        assert sorted(r.crc for r in ordered) == sorted(crc(whole(library, t)) for _, t in rows)
        path = shared_path(spark, f"test-typed-{number}")
        rans.write_files(held, path, file_ids=400)
        assert rans.read_files(spark, path, id_type="string").select("place").distinct().count() > 5
    pieces = packing.pack_tokens(held, ["id"], unit_ids=400, whole=False).collect()
    assert sum(p.length for p in pieces) == sum(len(whole(library, t)) for _, t in rows)
    check_packing(pieces, [], library)


def test_equal_rows_are_split_between_tasks(spark):
    held = tokens.tokenize(spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS id", "'one and the same text here' AS text"), ["id"])
    ranges = packing.pack_tokens(held, ["id"], unit_ids=300).selectExpr("shiftright(sequence, 32) AS r").groupBy("r").count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 200


def test_little_padding():
    """Random documents: sequences are padded by less than one id in a hundred, cuts inside sentences stay rare."""
    rng = np.random.default_rng(9)
    counts = rng.lognormal(5.5, 1.0, 800).astype(np.int64) + 2
    ids = rng.integers(3, 900, counts.sum()).astype(np.uint16)
    ids[np.cumsum(counts) - 1] = tokens.END
    stops = np.zeros(1 << 16, bool)
    stops[3:60] = True
    got = packing.pack_range(ids, counts, stops)
    size = np.bincount(got["sequence"], weights=got["length"]).astype(np.int64)
    padding = np.where(size & (size - 1) == 0, 0, packing.WINDOW - size)
    assert padding.sum() < 0.01 * counts.sum()
    ends = np.cumsum(counts)
    last = np.array([got["place"][got["sequence"] == s].max() + got["length"][got["sequence"] == s][-1] for s in range(len(size))])
    assert np.mean(np.isin(last, ends) | stops[ids[last - 1]]) > 0.9


def test_bytes_survive_the_text_sink(spark):
    """The sink writes bytes as they are, also those that are no text, whatever the session says of white space."""
    data = bytes(range(256)) * 3 + b"\n\r\n  "
    path = shared_path(spark, "test-bytes")
    rans._binary_files(spark.createDataFrame([(bytearray(data),), (bytearray(data[::-1]),)], "data binary"), path)
    assert {bytes(r.data) for r in rans._file_rows(spark, path).collect()} == {data, data[::-1]}
