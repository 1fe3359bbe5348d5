import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import matroska as m
from cairn.llm.common import raw_text


def test_sizes_are_the_shortest_and_read_back():
    for value in (0, 1, 126, 127, 128, 16_382, 16_383, 1 << 30):
        data = m.vint(value)
        assert m.read_vint(data, 0, len(data), False)[:2] == (value, len(data))
    assert len(m.vint(126)) == 1 and len(m.vint(127)) == 2


@pytest.mark.parametrize("kind", ["none", "xiph", "ebml", "fixed"])
def test_lacing_forms(kind):
    rng = random.Random(3)
    sizes = [40] if kind == "none" else [40] * 5 if kind == "fixed" else [3, 700, 255, 510, 1, 90]
    frames = [rng.randbytes(s) for s in sizes]
    cluster = m.element(m.CLUSTER, m.element(m.TIMESTAMP, b"\x64") + m.element(m.SIMPLE, m.block(2, -5, frames, kind)))
    data = m.element(m.EBML, b"") + m.element(m.SEGMENT, cluster)
    got = m.parse(data).packets
    assert [data[p.offset : p.offset + p.length] for p in got] == frames
    assert {(p.track, p.timestamp) for p in got} == {(2, 95_000_000)} and [p.lace for p in got] == list(range(len(frames)))


def test_unknown_sizes_block_groups_and_other_elements():
    block = m.element(m.GROUP, m.element(m.BLOCK, m.block(1, 0, [b"abc"])) + m.element(0x9B, b"\x01"))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.element(m.TIMESTAMP, b"\x07") + m.element(0xEC, b"void") + block
    segment = m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    data = m.element(m.EBML, b"") + segment + cluster + cluster
    got = m.parse(data).packets
    assert [data[p.offset : p.offset + p.length] for p in got] == [b"abc", b"abc"] and len({p.cluster for p in got}) == 2


def test_cues_point_at_clusters():
    data = m.mux(bytes(576 * 1000))
    parsed = m.parse(data)
    body = data.index(m.INFO.to_bytes(4, "big")) if m.INFO.to_bytes(4, "big") in data else 0
    assert len(parsed.cues) == 3 and len(parsed.packets) == 1000
    assert [c["cluster"] for c in parsed.cues] == sorted({p.cluster for p in parsed.packets})
    for c in parsed.cues:
        assert data[body + c["cluster"] :][:4] == m.CLUSTER.to_bytes(4, "big")
    assert parsed.tracks[0] == {"number": 1, "type": 2, "duration": 12_000_000, "codec": "A_PCM/INT/LIT", "rate": 48_000.0} and parsed.duration == 12_000


def test_malformed_bytes_are_refused():
    good = m.mux(bytes(576))
    for bad in (good[:-3], b"\x00" * 20, good[:40]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            m.parse(bad)


def test_round_trip_of_a_table(docs, empty):
    rows = docs.select("doc_id", "text", m.to_media(raw_text()).alias("media"), m.digest(m.to_media(raw_text())).alias("d")).collect()
    for r in rows:
        raw = (r.text or "").encode()
        want = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        assert r.d.payload_sha256 == hashlib.sha256(want).hexdigest() and r.d.payload_bytes == len(want) and r.d.tail_crc32 == zlib.crc32(want[-32:])
        assert r.d.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.d.media_bytes == len(r.media)
    assert empty.select(m.digest(m.to_media(raw_text()))).count() == 0


def test_packet_tables(docs):
    stored = docs.where("doc_id IN (0, 9)").select("doc_id", m.to_media(raw_text()).alias("media")).union(docs.where("doc_id = 1").select("doc_id", F.lit(b"junk")))
    got = m.packets(stored, "doc_id", "media").groupBy("id").agg(F.sum("length").alias("bytes"), F.max("timestamp").alias("last")).collect()
    assert {r.id for r in got} == {0, 9} and all(r.bytes % 576 == 0 and r.last == (r.bytes // 576 - 1) * 12_000_000 for r in got)
