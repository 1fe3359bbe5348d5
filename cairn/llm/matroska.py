"""Media columns: Matroska files as packet tables.

``mux`` writes a byte payload as 8-bit PCM audio (one track, EBML header,
clusters of laced simple blocks, cues); ``parse`` reads any Matroska bytes:
variable-length element ids and sizes (also unknown sizes), clusters, simple
blocks and block groups, all four lacing forms, and cues, into packet rows with
track, timestamp and byte range.  ``payload`` follows those byte ranges.

Defined cases: a null text counts as empty; the payload is padded with bytes
255 to a positive multiple of ``UNIT``; a truncated or malformed file raises
``ValueError`` in ``parse``; ``packets`` gives such a row no packets.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import tidy, values

UNIT = 576
RATE = 48_000
LACE = 8
BLOCKS_PER_CLUSTER = 52
#: Element ids of the Matroska specification that are used here.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0xD7, 0x73C5, 0x83, 0x86
SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
DOC_TYPE = 0x4282
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE_POINT, CUE_POSITIONS}


def vint(value: int) -> bytes:
    """A size as the shortest variable-length integer (all ones is reserved)."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def lace_sizes(sizes: list[int], kind: str) -> bytes:
    """The lacing header after the block header: frame count minus one, then sizes."""
    head = bytes([len(sizes) - 1])
    if kind == "xiph":
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == "ebml":
        out = head + vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1]):
            n, d = 1, now - before
            while not -((1 << 7 * n - 1) - 1) <= d <= (1 << 7 * n - 1) - 1:
                n += 1
            out += (d + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
        return out
    return head


LACE_FLAG = {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}


def block(track: int, relative: int, frames: list[bytes], kind: str | None = None) -> bytes:
    """Body of a (simple) block; equal frames are laced with a fixed size, others as EBML differences."""
    if kind is None:
        kind = "none" if len(frames) == 1 else "fixed" if len({*map(len, frames)}) == 1 else "ebml"
    head = vint(track) + struct.pack(">hB", relative, 0x80 | LACE_FLAG[kind])
    return head + (b"" if kind == "none" else lace_sizes([len(f) for f in frames], kind)) + b"".join(frames)


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """The payload as one PCM track: ``unit`` bytes a frame, ``LACE`` frames a block."""
    ms = unit * 1000 // rate
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    audio = element(SAMPLING, struct.pack(">d", rate)) + element(CHANNELS, b"\x01") + element(BIT_DEPTH, b"\x08")
    track = element(TRACK_NUMBER, b"\x01") + element(TRACK_UID, b"\x01") + element(TRACK_TYPE, b"\x02") + element(DEFAULT_DURATION, number(ms * 1_000_000)) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    n = -(-len(payload) // unit)
    info = element(TIMESTAMP_SCALE, number(1_000_000)) + element(DURATION, struct.pack(">d", n * ms)) + element(MUXING_APP, b"cairn") + element(WRITING_APP, b"cairn")
    body = [element(INFO, info), element(TRACKS, element(TRACK, track))]
    at, cues = sum(map(len, body)), []
    for first in range(0, n, LACE * BLOCKS_PER_CLUSTER):
        parts = [element(TIMESTAMP, number(first * ms))]
        for b in range(first, min(n, first + LACE * BLOCKS_PER_CLUSTER), LACE):
            frames = [payload[i * unit : (i + 1) * unit] for i in range(b, min(n, b + LACE, first + LACE * BLOCKS_PER_CLUSTER))]
            parts.append(element(SIMPLE, block(1, (b - first) * ms, frames)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, element(CUE_TIME, number(first * ms)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER, number(at)))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    length: int
    cluster: int
    lace: int
    key: bool


class Parsed(NamedTuple):
    tracks: list
    packets: list
    cues: list
    scale: int
    duration: float


def read_vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, position after it, and whether all value bits are ones."""
    if at >= end or not data[at]:
        raise ValueError(f"bad variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError(f"truncated at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    low = value & (1 << 7 * n) - 1
    return (value if keep_marker else low), at + n, low == (1 << 7 * n) - 1


def frames_of(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames, from its lacing."""
    kind = flags & 6
    if not kind:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if kind == 4:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError("fixed-size lacing does not divide the block")
        return [(at + i * size, size) for i in range(count)]
    sizes = []
    for i in range(count - 1):
        if kind == 2:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            value, at, _ = read_vint(data, at, end, False)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Parsed:
    """Walk the elements once and gather tracks, packets and cues."""
    tracks, packets, cues, scale, duration = [], [], [], 1_000_000, 0.0
    segment_at, cluster, cluster_time, track = 0, -1, 0, {}
    cue = {}
    stack = [(0, len(data), 0)]
    while stack:
        at, end, inside = stack.pop()
        while at < end:
            ident, body, _ = read_vint(data, at, end, True)
            size, body, unknown = read_vint(data, body, end, False)
            stop = end if unknown else body + size
            if stop > end:
                raise ValueError(f"element at {at} passes its parent")
            if ident in MASTERS:
                if ident == SEGMENT:
                    segment_at = body
                elif ident == CLUSTER:
                    cluster, cluster_time = at - segment_at, 0
                elif ident == TRACK:
                    track = {}
                    tracks.append(track)
                elif ident == CUE_POINT:
                    cue = {}
                    cues.append(cue)
                stack.append((stop, end, inside))
                if ident == CLUSTER and unknown:  # ends where the next cluster or cues begin
                    stop = _unknown_end(data, body, end)
                    stack[-1] = (stop, end, inside)
                at, end, inside = body, stop, ident
                continue
            value = data[body:stop] if ident not in (SIMPLE, BLOCK) else b""
            if ident == SIMPLE or ident == BLOCK:
                who, here, _ = read_vint(data, body, stop, False)
                relative, flags = struct.unpack_from(">hB", data, here)
                # laced frames follow each other by the track's default duration, if it has one
                step = next((t.get("duration", 0) for t in tracks if t.get("number") == who), 0)
                for lace, (start, length) in enumerate(frames_of(data, here + 3, stop, flags)):
                    packets.append(Packet(who, (cluster_time + relative) * scale + lace * step, start, length, cluster, lace, bool(flags & 0x80) or ident == BLOCK))
            elif ident == TIMESTAMP:
                cluster_time = int.from_bytes(value, "big")
            elif ident == TIMESTAMP_SCALE:
                scale = int.from_bytes(value, "big")
            elif ident == DURATION:
                duration = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
            elif ident in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                track[{TRACK_NUMBER: "number", TRACK_TYPE: "type"}.get(ident, "duration")] = int.from_bytes(value, "big")
            elif ident == CODEC:
                track["codec"] = value.decode("ascii", "replace")
            elif ident == SAMPLING:
                track["rate"] = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
            elif ident == CUE_TIME:
                cue["time"] = int.from_bytes(value, "big")
            elif ident == CUE_TRACK:
                cue["track"] = int.from_bytes(value, "big")
            elif ident == CUE_CLUSTER:
                cue["cluster"] = int.from_bytes(value, "big")
            at = stop
    return Parsed(tracks, packets, cues, scale, duration)


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body, _ = read_vint(data, at, end, True)
        if ident in (CLUSTER, CUES, INFO, TRACKS):
            return at
        size, body, _ = read_vint(data, body, end, False)
        at = body + size
    return min(at, end)


def payload(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.length] for p in parsed.packets if p.track == track)


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b"\xff" * (unit - len(raw) % unit if len(raw) % unit or not raw else 0)


def feature(samples: bytes, parsed: Parsed) -> str:
    """Signal figures of the samples read back: counts, level, crossings, steps and the level by quarter."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    step = np.abs(np.diff(x))
    cross = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    level = [f"{np.sqrt((q.astype(np.int64) ** 2).mean()):.3f}" for q in np.array_split(x, 4)]
    return (
        f"packets={len(parsed.packets)};clusters={len(parsed.cues)};ms={parsed.duration:.0f};mean={x.mean():.4f};"
        f"rms={np.sqrt((x.astype(np.int64) ** 2).mean()):.4f};zcr={cross};step={step.mean():.4f};peak={int(np.abs(x).max())};rms4={','.join(level)}"
    )


@F.arrow_udf(T.BinaryType())
def to_media(raw: pa.Array) -> pa.Array:
    """UTF-8 bytes (null: empty) to the stored Matroska bytes."""
    return pa.array([mux(padded(t or b"")) for t in values(raw)], pa.large_binary() if raw.nbytes > 1 << 30 else pa.binary())


DIGEST = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


@F.arrow_udf(DIGEST)
def digest(media: pa.Array) -> pa.Array:
    """Read stored bytes back through their packet table and describe what was read."""
    rows = []
    for data in values(media):
        parsed = parse(data)
        got = payload(data, parsed)
        rows.append((len(got), hashlib.sha256(got).hexdigest(), crc32(got[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(got, parsed)))
    tidy()
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=DIGEST.names)


def _packet_rows(batches):
    for batch in batches:
        for ident, data in zip(batch.column(0), batch.column(1).to_pylist()):
            try:
                found = parse(data or b"").packets
            except (ValueError, IndexError, struct.error):
                continue
            if found:
                cols = [pa.array(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(found), batch.column(0).type), *cols], names=["id", *Packet._fields])


def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet: id, track, timestamp (ns), byte range, cluster position, lace index, key flag."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(
        _packet_rows, f"id {kind}, track long, timestamp long, offset long, length long, cluster long, lace long, key boolean"
    )
