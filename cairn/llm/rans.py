"""Token-id files coded by a range asymmetric numeral system.

One static frequency table, counted over all ids of the corpus, is shared by
all files.  A file holds the ids of consecutive documents in ascending id
order, cut into independent blocks; a block interleaves ``LANES`` coder states
(64-bit states, 32-bit words) and carries its own checksum.  Checkpoints at the
end of a file give each block's byte position and first id, so blocks can be
decoded in parallel or alone.

Layout (little-endian): ``CRNS``, version, precision, lanes u16, block size
u32, table checksum u32, ids u64, documents u32, blocks u32; the packed document
table (document ids as 64-bit numbers or, of any other type, as text); blocks (ids u32, words u32, checksum u32, states, words); checkpoints
(byte position u64, first id u64) and their position u64.  Files are written by
Spark's own sink into a shared folder, so a lost task leaves no half file; each
ends with the row separator ``CRN1``.  The number of ranges that documents are
shuffled to is bounded; a task cuts its range into as many files as it takes.

Defined cases: a null text counts as empty and holds the end id alone; null
document ids come first; repeated rows are repeated documents (equal ids in
order of a hash of their token ids); an empty table makes no files and no rows.  A wrong
checksum raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, shared_path
from cairn.llm.tokens import END, tokenize

PRECISION = 18
LANES = 32
BLOCK = 16_384
#: Blocks coded side by side, ids of one file, and ranges at most.
ABREAST = 64
FILE_IDS, MOST_RANGES = 4_000_000, 4096
LOW = 1 << 31
HEAD = struct.Struct("<4sBBHIIQII")
BLOCK_HEAD = struct.Struct("<III")
SEPARATOR = "CRN1"
#: Types of ids that are kept as numbers.
NUMBERS = ("bigint", "int", "smallint", "tinyint")


class Table:
    """Frequencies scaled to ``2**PRECISION``, each present symbol at least one."""

    def __init__(self, counts: np.ndarray):
        present = np.nonzero(counts)[0]
        if len(present) > 1 << PRECISION:
            raise ValueError("more symbols than the table's precision")
        scaled = np.maximum(1, counts[present].astype(np.float64) / counts.sum() * (1 << PRECISION)).astype(np.int64)
        order = np.argsort(-scaled, kind="stable")
        over = int(scaled.sum()) - (1 << PRECISION)
        while over:
            for i in order:
                step = max(1 - scaled[i], -over) if over > 0 else -over
                step = max(step, -max(1, scaled[i] // 8)) if over > 0 else step
                scaled[i] += step
                over += int(step)
                if not over:
                    break
        self._set(present, scaled)

    def _set(self, present, scaled):
        self.freq, self.cum = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.freq[present] = scaled
        self.cum[present] = np.cumsum(scaled) - scaled
        self.symbol = np.repeat(present.astype(np.uint16), scaled)
        self.fill = int(present[np.argmax(scaled)])
        self.slot_freq = self.freq[self.symbol]
        self.slot_bias = np.arange(1 << PRECISION, dtype=np.uint64) - self.cum[self.symbol]
        self.data = b"CRNT" + struct.pack("<BI", PRECISION, len(present)) + present.astype("<u2").tobytes() + scaled.astype("<u4").tobytes()
        self.crc = zlib.crc32(self.data)

    @classmethod
    def read(cls, data: bytes) -> Table:
        magic, precision, n = struct.unpack_from("<4sBI", data)
        body = data[9 : 9 + 6 * n]
        if magic != b"CRNT" or precision != PRECISION or len(body) < 6 * n:
            raise ValueError("not a frequency table")
        table = cls.__new__(cls)
        table._set(np.frombuffer(body, "<u2", n).astype(np.int64), np.frombuffer(body, "<u4", n, 2 * n).astype(np.int64))
        return table


def encode_blocks(ids: np.ndarray, steps: int, table: Table) -> list[bytes]:
    """Blocks of ``steps * LANES`` ids each, coded side by side; ``ids`` fills them all."""
    s = ids.reshape(-1, steps, LANES)
    x = np.full((len(s), LANES), LOW, np.uint64)
    words, more = np.empty((steps, len(s), LANES), np.uint32), np.empty((steps, len(s), LANES), bool)
    limit, half, scale = np.uint64(63 - PRECISION), np.uint64(32), np.uint64(PRECISION)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[s[:, t]], table.cum[s[:, t]]
        over = x >= (f << limit)
        more[t], words[t] = over, x.astype(np.uint32)
        x = np.where(over, x >> half, x)
        q = x // f
        x = (q << scale) + (x - q * f) + c
    return [x[b].astype("<u8").tobytes() + words[:, b][more[:, b]].astype("<u4").tobytes() for b in range(len(s))]


def decode_blocks(bodies: list[bytes], steps: int, table: Table) -> np.ndarray:
    """The ids of blocks with the same number of steps, one row each."""
    n = len(bodies)
    x = np.stack([np.frombuffer(b, "<u8", LANES) for b in bodies]).astype(np.uint64)
    own = [np.frombuffer(b, "<u4", offset=8 * LANES) for b in bodies]
    width = max(map(len, own)) + LANES
    flat = np.zeros((n, width), np.uint32)
    for i, w in enumerate(own):
        flat[i, : len(w)] = w
    flat = flat.ravel()
    at = (np.arange(n) * width)[:, None]
    out = np.empty((n, steps, LANES), np.uint16)
    mask, scale, half, low = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32), np.uint64(LOW)
    for t in range(steps):
        slot = (x & mask).astype(np.int64)
        out[:, t] = table.symbol[slot]
        x = table.slot_freq[slot] * (x >> scale) + table.slot_bias[slot]
        need = x < low
        rank = np.cumsum(need, axis=1)
        x = np.where(need, (x << half) | flat[at + np.maximum(rank - 1, 0)], x)
        at = at + rank[:, -1:]
    return out.reshape(n, -1)


def encode_file(ids: np.ndarray, doc_ids: list, counts: np.ndarray, table: Table) -> bytes:
    """One file: ``ids`` of documents ``doc_ids`` (None allowed) with ``counts`` ids each."""
    full = len(ids) // BLOCK
    sizes = [BLOCK] * full + ([len(ids) - full * BLOCK] if len(ids) % BLOCK else [])
    bodies = []
    for b in range(0, full, ABREAST):
        bodies += encode_blocks(ids[b * BLOCK : min(full, b + ABREAST) * BLOCK], BLOCK // LANES, table)
    if len(sizes) > full:
        steps = -(-sizes[-1] // LANES)
        rest = np.full(steps * LANES, table.fill, np.uint16)
        rest[: sizes[-1]] = ids[full * BLOCK :]
        bodies += encode_blocks(rest, steps, table)
    known = np.array([d is not None for d in doc_ids])
    if any(isinstance(d, str) for d in doc_ids):
        texts = [(d or "").encode() for d in doc_ids]
        names = b"t" + np.array([len(t) for t in texts], "<u4").tobytes() + b"".join(texts)
    else:
        names = b"i" + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    docs = zlib.compress(np.packbits(known).tobytes() + np.asarray(counts, "<u4").tobytes() + names, 3)
    parts = [HEAD.pack(b"CRNS", 1, PRECISION, LANES, BLOCK, table.crc, len(ids), len(doc_ids), len(sizes)), struct.pack("<I", len(docs)), docs]
    at, marks, first = sum(map(len, parts)), [], 0
    for size, body in zip(sizes, bodies):
        marks.append((at, first))
        parts.append(BLOCK_HEAD.pack(size, len(body) // 4 - 2 * LANES, zlib.crc32(body)) + body)
        at, first = at + len(parts[-1]), first + size
    parts.append(np.array(marks, "<u8").tobytes() + struct.pack("<Q", at))
    return b"".join(parts)


def decode_file(data: bytes, table: Table, blocks: range | None = None) -> tuple[np.ndarray, list, np.ndarray]:
    """``ids, doc_ids, counts`` of a file; ``blocks`` limits the ids to those of some blocks."""
    magic, version, precision, lanes, block, crc, n_ids, n_docs, n_blocks = HEAD.unpack_from(data)
    if (magic, version, precision, lanes, block) != (b"CRNS", 1, PRECISION, LANES, BLOCK) or crc != table.crc:
        raise ValueError("not a token file of this table")
    (size,) = struct.unpack_from("<I", data, HEAD.size)
    docs = zlib.decompress(data[HEAD.size + 4 : HEAD.size + 4 + size])
    bits = -(-n_docs // 8)
    known = np.unpackbits(np.frombuffer(docs, np.uint8, bits))[:n_docs]
    counts = np.frombuffer(docs, "<u4", n_docs, bits).astype(np.int64)
    kind, at = docs[bits + 4 * n_docs : bits + 4 * n_docs + 1], bits + 4 * n_docs + 1
    if kind == b"t":
        ends = np.cumsum(np.frombuffer(docs, "<u4", n_docs, at), dtype=np.int64) + at + 4 * n_docs
        doc_ids = [docs[a:b].decode() if k else None for a, b, k in zip([at + 4 * n_docs, *ends[:-1].tolist()], ends.tolist(), known)]
    else:
        doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(docs, "<i8", n_docs, at), known)]
    end = len(data) - 8
    (marks_at,) = struct.unpack_from("<Q", data, end)
    marks = np.frombuffer(data, "<u8", 2 * n_blocks, marks_at).reshape(-1, 2)
    chosen = range(n_blocks) if blocks is None else blocks
    sizes, bodies = [], []
    for b in chosen:
        at = int(marks[b, 0])
        n, words, check = BLOCK_HEAD.unpack_from(data, at)
        body = data[at + BLOCK_HEAD.size : at + BLOCK_HEAD.size + 8 * LANES + 4 * words]
        if zlib.crc32(body) != check:
            raise ValueError(f"block {b} is damaged")
        sizes.append(n)
        bodies.append(body)
    out, b = [np.empty(0, np.uint16)], 0
    while b < len(bodies):
        stop = b + 1
        while stop < len(bodies) and stop - b < ABREAST and sizes[stop] == sizes[b]:
            stop += 1
        got = decode_blocks(bodies[b:stop], -(-sizes[b] // LANES), table)
        out.append(got[:, : sizes[b]].ravel())
        b = stop
    return np.concatenate(out), doc_ids, counts


def _count(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            total += np.bincount(np.frombuffer(ids.as_buffer(), np.uint16), minlength=1 << 16)
    found = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["symbol", "n"])


def count_table(tokens: DataFrame) -> Table | None:
    """The shared table from the counts of all ids; at most 65,536 rows reach the driver."""
    got = tokens.select("ids").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    counts = np.zeros(1 << 16, np.int64)
    counts[got.column("symbol").to_numpy()] = got.column("n").to_numpy()
    return Table(counts)


def _write(shared, file_ids):
    """Files of about ``file_ids`` ids (whole documents), each behind its place in the order."""

    def run(batches):
        place, doc_ids, counts, parts, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for ident, n, ids in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                if held and held + n > file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<Q", place) + encode_file(np.concatenate(parts), doc_ids, np.array(counts), shared.value)], pa.binary())], names=["data"])
                    place, doc_ids, counts, parts, held = place + 1, [], [], [], 0
                doc_ids.append(ident)
                counts.append(n)
                parts.append(np.frombuffer(ids.as_buffer(), np.uint16))
                held += n
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<Q", place) + encode_file(np.concatenate(parts), doc_ids, np.array(counts), shared.value)], pa.binary())], names=["data"])

    return run


def _binary_files(df: DataFrame, path: str):
    """Each row of the one binary column as a file of raw bytes and the separator, through Spark's text sink (which writes bytes as they are)."""
    text = df.select(F.col(df.columns[0]).cast("string").alias("value")).write.option("compression", "none").option("lineSep", SEPARATOR)
    text.option("maxRecordsPerFile", 1).text(path)


def _file_rows(spark, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > len(SEPARATOR))
    return found.select(F.expr(f"substring(content, 1, length - {len(SEPARATOR)})").alias("data"))


def write_files(tokens: DataFrame, path: str, file_ids: int = FILE_IDS) -> Table | None:
    """Write ``tokens`` (``id, n, ids``) as files in ascending id order and the table beside them."""
    spark = tokens.sparkSession
    table = count_table(tokens)
    if table is None:
        return None
    _binary_files(spark.createDataFrame([(bytearray(table.data),)], "data binary").coalesce(1), f"{path}/table")
    total = tokens.agg(F.sum("n")).first()[0]
    shared = spark.sparkContext.broadcast(table)
    by = (F.col("id").asc_nulls_first(), F.xxhash64("ids"))
    # numbers as they are, other ids as text; the row's number splits even rows that are equal in everything
    kept = F.col("id").cast("long" if tokens.schema["id"].dataType.simpleString() in NUMBERS else "string").alias("id")
    ranged = tokens.select("id", "n", "ids", F.monotonically_increasing_id().alias("__row")).repartitionByRange(min(MOST_RANGES, -(-total // file_ids)), *by, "__row")
    ordered = ranged.sortWithinPartitions(*by, "__row").select(kept, "n", "ids")
    _binary_files(ordered.mapInArrow(_write(shared, file_ids), "data binary"), f"{path}/ids")
    return table


def _read(shared, whole, kind):
    def run(batches):
        table = shared.value
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                (place,) = struct.unpack_from("<Q", data)
                ids, doc_ids, counts = decode_file(data[8:], table)
                ends = np.cumsum(counts)
                starts = ends - counts
                if whole:
                    last = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)], pa.binary())
                else:
                    wide = ids.astype("<u4")
                    last = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), place)), pa.array(doc_ids, kind), pa.array(starts), pa.array(counts), last],
                    names=["place", "id", "start", "n", "ids" if whole else "crc"],
                )

    return run


def read_files(spark, path: str, whole: bool = True, id_type: str = "bigint") -> DataFrame:
    """Documents of the files: ``place`` (of the file), ``id, start`` (in it), ``n`` and ``ids`` (or their ``crc``)."""
    tables = _file_rows(spark, f"{path}/table").limit(1).collect()
    shared = spark.sparkContext.broadcast(Table.read(bytes(tables[0][0])))
    number = id_type in NUMBERS
    rows = _file_rows(spark, f"{path}/ids").mapInArrow(_read(shared, whole, pa.int64() if number else pa.string()), f"place long, id {'long' if number else 'string'}, start long, n long, {'ids binary' if whole else 'crc long'}")
    return rows.withColumn("id", F.col("id").cast(id_type))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """``id, start, n, crc`` of every document as read back from the files written for ``docs``."""
    spark = docs.sparkSession
    tokens = cut(tokenize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), ["id"], "__text", end=end), "token-ids")
    path, kind = shared_path(spark, "token-files"), tokens.schema["id"].dataType.simpleString()
    if write_files(tokens, path) is None:
        return tokens.select("id", F.lit(0).cast("long").alias("start"), "n", F.lit(0).cast("long").alias("crc"))
    rows = cut(read_files(spark, path, whole=False, id_type=kind), "token-docs")
    # positions of files: sums of whole ranges, then inside a range; one row per file, of which a range has a bounded share
    files = rows.groupBy("place").agg(F.sum("n").alias("ids")).withColumn("range", F.shiftright("place", 32))
    ranges = files.groupBy("range").agg(F.sum("ids").alias("all"))
    ranges = ranges.select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("first"))
    inside = F.sum("ids").over(Window.partitionBy("range").orderBy("place")) - F.col("ids")
    before = files.withColumn("inside", inside).join(ranges, "range").select("place", (F.col("first") + F.col("inside")).alias("before"))
    return rows.join(before, "place").select("id", (F.col("before") + F.col("start")).alias("start"), "n", "crc")
