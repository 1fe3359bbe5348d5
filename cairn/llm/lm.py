"""Language-model scores of whole texts, beside a smoothed word-frequency base.

Model: ids of the subword vocabulary; a causal self-attention network gives the
next id's class, and corpus counts give the id's share of its class after the
class before it; phrases that other training texts have in the same context are
remembered beside it (``phrases``).

Texts are read once: their ids and words go to an intermediate table.  Nothing is
learned from a sample.  Classes come from the neighbours of all training ids.  The
network is trained on all training texts in ``ROUNDS`` rounds: in each, every
partition trains all tables, embeddings too, on its texts of the round, and the
results are averaged by the ids they have seen.  A text has one round; a small
corpus goes through all of them several times.  Class pairs are counted over all
training ids, and the phrase memory is the whole training corpus.

Counts of words (64-bit hashes) and phrases are added up in buckets of the hash
space, to which blocks of texts send what they have.  A frequent key goes another
way, so that no bucket gets a hot one: it is counted where it is read, one number
per partition, and looked up in a bounded table.  Which keys are frequent follows
from the counts of all training texts: every partition names those that reach its
share of the least count, so that no key that reaches it in all is missed, and the
named counts are added up.  Which way a word goes does not change any result; after
a frequent context, phrases that are not frequent share what is left.  A block
sends at most one row for each of its distinct keys, so that shuffled bytes grow
in proportion to the text at every size.

Defined cases: a null text counts as empty and has one token, the end; repeated
rows are scored (and counted) as often as they occur; null ids count as the
empty text when folds are drawn; without training texts the base takes N = V = 0
and the model only its priors; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.attention import CLASSES, DIM, SMALL, SPREAD, VOCABULARY, WINDOW, Model, id_pairs, inputs_of, learn_classes, neighbour_cells
from cairn.llm.common import cut, parts_of, raw_text, text_bytes, tidy
from cairn.llm.hashing import run_hashes
from cairn.llm.phrases import cut_phrases, gains, pair_keys, times_in_group
from cairn.llm.tokens import AT_ONCE, encoded, pieces, units, vocabulary_path

#: One training text in so many trains the network, and the rounds they are dealt to.
REFINE_EVERY, ROUNDS = 1, 2
#: Ids that the network is trained on at least, a smaller corpus up to eight times.
FIRST_IDS = 8_000_000
#: Keys go the way of frequent ones that are seen so often in so many bytes of text (and so often in all), and so many of each kind at most.
OFTEN, OFTEN_BYTES, MOST_HOT = 3, 8 << 20, 1 << 17
BLOCK_IDS, BLOCK_DOCS = 1_000_000, 20_000
BUCKET_BYTES = 4 << 20
#: Slices of the tables that partitions add up, and partitions whose slices meet first.
SLICES, NEAR = 64, 16
_FLUSH = 2 << 20
#: Numbers of an averaged row: a vector, its sum of squared gradients, the weight.
WIDE = DIM + 2


# ---- reading


def word_keys(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of some texts, and the number of words of each text."""
    keys, n_words, i = [], np.zeros(len(raws), np.int64), 0
    while i < len(raws):
        j, size = i + 1, len(raws[i])
        while j < len(raws) and size + len(raws[j]) < AT_ONCE:
            size += len(raws[j]) + 1
            j += 1
        for part in pieces(raws[i]) if j == i + 1 else [b"\n".join(raws[i:j])]:
            x = np.frombuffer(part.lower(), np.uint8)
            starts, ends = units(x, False)
            if len(starts):
                keys += run_hashes(x, starts, ends, 1)
            limits = np.cumsum([len(r) + 1 for r in raws[i:j]]) if j > i + 1 else [len(x)]
            n_words[i:j] += np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
        i = j
    return np.concatenate(keys) if keys else np.empty(0, np.uint64), n_words


class Hot(NamedTuple):
    """Sorted keys that are frequent in the training texts: words, contexts, contexts with phrases (and whose they are)."""

    words: np.ndarray
    contexts: np.ndarray
    pairs: np.ndarray
    context_of: np.ndarray

    @classmethod
    def of(cls, named) -> Hot:
        """From ``(kind, keys, counts, owners)`` of the frequent keys of all partitions."""
        found = []
        for kind in range(3):
            keys, n, owner = (np.concatenate([np.zeros(0, t), *(x[i] for x in named if x[0] == kind)]) for i, t in ((1, np.uint64), (2, np.int64), (3, np.uint64)))
            if kind == 2:
                mine = lookup(found[1][0], owner) >= 0
                keys, n, owner = keys[mine], n[mine], owner[mine]
            top = np.lexsort((keys, -n))[:MOST_HOT]
            top = top[np.argsort(keys[top])]
            found.append((keys[top], owner[top]))
        return cls(found[0][0], found[1][0], found[2][0], lookup(found[1][0], found[2][1]))

    def sizes(self) -> np.ndarray:
        """Where the counts of words, contexts and pairs start in one row of counters, and its end."""
        return np.cumsum([0, len(self.words), len(self.contexts), len(self.pairs)])


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they are not in it.

    Keys are hashes: the highest bits lead to a short run of the table, whose
    entries are tried one after another.
    """
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    edge, shift = _edges_of(table)
    bucket = (keys >> shift).astype(np.int64)
    at, end = edge[bucket], edge[bucket + 1]
    out = np.full(len(keys), -1, np.int64)
    todo = np.nonzero(at < end)[0]
    while len(todo):
        here = at[todo]
        hit = table[here] == keys[todo]
        out[todo[hit]] = here[hit]
        todo = todo[~hit]
        at[todo] += 1
        todo = todo[at[todo] < end[todo]]
    return out


_EDGES: dict[int, tuple] = {}


def _edges_of(table: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Where the runs of a sorted table with the same highest bits start; kept for the tables in use."""
    found = _EDGES.get(id(table))
    if found is None or found[0] is not table:
        bits = max(1, int(len(table)).bit_length() + 1)
        edge = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        if len(_EDGES) > 8:
            _EDGES.clear()
        found = _EDGES[id(table)] = (table, np.append(edge, len(table)).astype(np.int64), np.uint64(64 - bits))
    return found[1], found[2]


def _binaries(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of a flat array as binary values."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * flat.itemsize
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    return pa.array([flat[a : a + n].tobytes() for a, n in zip(np.cumsum(lengths) - lengths, lengths)], pa.binary())


def _sparse(total: np.ndarray):
    """Counters in slices: ``key, data`` with the cells that are not zero."""
    cells = np.nonzero(total)[0]
    for s in range(SLICES):
        mine = cells[cells % SLICES == s]
        if len(mine):
            yield s, mine.astype("<u4").tobytes() + total[mine].astype("<i8").tobytes()


def _runs_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often each occurs."""
    flat = np.concatenate(parts)
    flat.sort()
    first = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0] if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.diff(first, append=len(flat)).astype(np.int32)


class Counters:
    """Counts of cells, added up in sorted runs: what is kept beside the table stays small."""

    def __init__(self, size: int):
        self.total, self.cells, self.pairs, self.n = np.zeros(size, np.int32), [], [], 0

    def add(self, cells: np.ndarray) -> None:
        self.cells.append(cells.astype(np.int32))
        self._more(len(cells))

    def add_neighbours(self, pairs: np.ndarray) -> None:
        """Pairs of neighbouring ids; their cells stand at the start of the table."""
        self.pairs.append(pairs)
        self._more(len(pairs))

    def _more(self, n: int) -> None:
        self.n += n
        if self.n > _FLUSH:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.cells:
            cells, times = _runs_of(self.cells)
            self.total[cells] += times
        if self.pairs:
            cells, times = neighbour_cells(*_runs_of(self.pairs))
            np.add.at(self.total, cells, times)
        self.cells, self.pairs, self.n = [], [], 0
        return self.total


def _dense(slices, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for data in slices:
        n = len(data) // 12
        out[np.frombuffer(data, "<u4", n)] += np.frombuffer(data, "<i8", n, 4 * n)
    return out


def _add_up(key: str):
    """Add the slices of one key up: sparse counters, and sums of vectors (``vector``: numbers u4, then rows of f8)."""

    def run(table: pa.Table) -> pa.Table:
        cells = [bytes(v.as_buffer()) for v in table.column("data") if v.is_valid]
        data = None
        if cells:
            ids = np.concatenate([np.frombuffer(v, "<u4", len(v) // 12) for v in cells])
            counts = np.concatenate([np.frombuffer(v, "<i8", len(v) // 12, 4 * (len(v) // 12)) for v in cells])
            cell, where = np.unique(ids, return_inverse=True)
            data = cell.astype("<u4").tobytes() + np.bincount(where, weights=counts).astype("<i8").tobytes()
        vectors = [bytes(v.as_buffer()) for v in table.column("vector") if v.is_valid]
        vector = None
        if vectors:
            parts = [_rows_of(v) for v in vectors]
            number, where = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
            rows = np.zeros((len(number), WIDE))
            np.add.at(rows, where, np.concatenate([r for _, r in parts]))
            vector = number.astype("<u4").tobytes() + rows.astype("<f8").tobytes()
        part = [pa.scalar(table.column("part")[0].as_py())] if key == "part" else []
        names = ["key", *(["part"] if part else []), "data", "vector"]
        values = [table.column("key")[0].as_py(), *(p.as_py() for p in part), data, vector]
        kinds = [pa.int64(), *([pa.int64()] if part else []), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    return run


def _rows_of(data: bytes):
    n = len(data) // (4 + 8 * WIDE)
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, "<f8", n * WIDE, 4 * n).reshape(n, WIDE)


def _summed(rows: DataFrame) -> pa.Table:
    """Slices of all partitions added up, those of near partitions first; what reaches the driver has the size of the tables."""
    near = rows.groupBy("key", "part").applyInArrow(_add_up("part"), "key long, part long, data binary, vector binary")
    return near.groupBy("key").applyInArrow(_add_up("key"), "key long, data binary, vector binary").toArrow()


class Tally:
    """Counts of keys, kept as sorted runs."""

    def __init__(self):
        self.parts, self.size, self.runs, self.held = [], 0, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(keys)
        self.size += len(keys)
        if self.size > _FLUSH:
            self.flush()

    def flush(self) -> None:
        if self.size:
            self.runs.append(_runs_of(self.parts))
            self.held += len(self.runs[-1][0])
            self.parts, self.size = [], 0
        if self.held > 2 * _FLUSH and len(self.runs) > 4:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([np.zeros(0, t), *(r[i] for r in self.runs)]) for i, t in ((0, np.uint64), (1, np.int64)))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
        self.runs = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
        self.held = len(first)
        return self.runs[0]


def least_count(size: int) -> float:
    """Occurrences from which on a key is frequent in ``size`` bytes of text."""
    return max(OFTEN, OFTEN * size / OFTEN_BYTES)


def _named(words: Tally, contexts: list, phrases: list, least: float):
    """Keys of a partition with ``least`` occurrences or more: ``slice, data`` (keys, counts, owners)."""
    words.flush()
    context, phrase = np.concatenate([np.zeros(0, np.uint64), *contexts]), np.concatenate([np.zeros(0, np.uint32), *phrases])
    pair = pair_keys(context, phrase)
    for kind, (keys, n) in enumerate((words.merge(), _runs_of([context]), _runs_of([pair]))):
        keys, n, owner = keys[n >= least], n[n >= least], np.zeros(int((n >= least).sum()), np.uint64)
        if kind == 2:
            at = lookup(keys, pair)
            owner[at[at >= 0]] = context[at >= 0]
        place = keys % np.uint64(SLICES)
        for s in range(SLICES):
            mine = place == s
            if mine.any():
                yield kind * SLICES + s, keys[mine].astype("<u8").tobytes() + n[mine].astype("<i8").tobytes() + owner[mine].astype("<u8").tobytes()


def _named_of(data: bytes):
    n = len(data) // 24
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<u8", n, 16 * n)


def _frequent(least: float):
    """Add up what partitions have named, and keep what reaches ``least`` (``MOST_HOT`` of a slice at most)."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_named_of(bytes(v.as_buffer())) for v in table.column("data")]
        keys, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        owner = np.concatenate([p[2] for p in parts])[first]
        top = np.lexsort((keys, -n))[:MOST_HOT]
        top = top[n[top] >= least]
        data = keys[top].astype("<u8").tobytes() + n[top].astype("<i8").tobytes() + owner[top].astype("<u8").tobytes()
        return pa.Table.from_arrays([pa.array([table.column("key")[0].as_py()], pa.int64()), pa.array([data], pa.binary())], names=["key", "data"])

    return run


COLUMNS = ["kind", "key", "part", "data", "id", "train", "ids", "words"]


def _read_texts(path, id_type, size):
    """Rows of documents (ids, hashes of words) and, last, the partition's counts of neighbours and its frequent keys; ``size``: bytes of all texts."""

    def run(batches):
        total, words, contexts, phrases, own_bytes = Counters(VOCABULARY * 2 * SPREAD), Tally(), [], [], 0
        for batch in parts_of(batches, 1024):
            raws, train = batch.column("raw").to_pylist(), batch.column("train").to_numpy(zero_copy_only=False)
            own_bytes += sum(map(len, raws))
            for i, j, ids, counts in encoded(raws, path):
                keys, n_words = word_keys(raws[i:j])
                learned, n = np.repeat(train[i:j], counts), j - i
                if learned.any():
                    own, own_counts = ids[learned], counts[train[i:j]]
                    total.add_neighbours(id_pairs(own, own_counts))
                    words.add(keys[np.repeat(train[i:j], n_words)])
                    _, _, _, context, phrase = cut_phrases(own, own_counts)
                    contexts.append(context)
                    phrases.append(phrase)
                columns = [np.zeros(n, np.int32), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), batch.column("id").slice(i, n), batch.column("train").slice(i, n), _binaries(ids, counts), _binaries(keys, n_words)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], names=COLUMNS)
        part = TaskContext.get().partitionId() // NEAR
        rows = [(1, *r) for r in _sparse(total.flush())] + [(2, *r) for r in _named(words, contexts, phrases, least_count(size) * own_bytes / max(1, size))]
        del total, words, contexts, phrases
        tidy(caches=False)
        for kind, key, data in rows:
            columns = [pa.array([kind], pa.int32()), pa.array([key], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary()), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), *[pa.nulls(1, pa.binary())] * 2]
            yield pa.RecordBatch.from_arrays(columns, names=COLUMNS)

    return run


def _flat(column: pa.ChunkedArray | pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Binary values one after another as numbers, and how many each has."""
    parts, lengths = [], []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        if chunk.type != pa.binary() or chunk.null_count:
            values = [v.as_py() or b"" for v in chunk]
            parts.append(np.frombuffer(b"".join(values), np.uint8))
            lengths.append(np.array([len(v) for v in values], np.int64))
            continue
        _, places, data = chunk.buffers()
        edge = np.frombuffer(places, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8))
        lengths.append(np.diff(edge).astype(np.int64))
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate(parts).view(kind), np.concatenate(lengths) // np.dtype(kind).itemsize


# ---- fitting


class Fitted(NamedTuple):
    """The network with its shares, the counts of hot keys (words, contexts, pairs), and the table of ids and words that the texts were read to."""

    model: Model
    hot: Hot
    counters: np.ndarray
    texts: DataFrame


def _train(shared, turn: int, epochs: int, whole: bool):
    """The tables trained on by this partition: its texts of the round ``turn`` (or ``whole``, all); in the first round also the counts of (class before, id) and of frequent keys."""

    def run(batches):
        model, hot = shared.value
        tidy()
        edges = CLASSES * VOCABULARY + hot.sizes()
        total, parts, sizes = Counters(int(edges[-1]) if turn == 0 else 0), [], []
        for batch in parts_of(batches, 1024):
            ids, counts = _flat(batch.column("ids"), np.uint16)
            if not len(ids):
                continue
            if turn == 0:
                total.add(model.classes[inputs_of(ids, counts)] * VOCABULARY + ids)
                _, _, _, context, phrase = cut_phrases(ids, counts)
                at = lookup(hot.contexts, context)
                known = at >= 0
                pair = lookup(hot.pairs, pair_keys(context[known], phrase[known]))
                word = lookup(hot.words, _flat(batch.column("words"), np.uint64)[0])
                for edge, place in zip(edges, (word, at, pair)):
                    total.add(edge + place[place >= 0])
            keep = np.full(len(counts), True) if whole else batch.column("turn").to_numpy(zero_copy_only=False) == turn
            if keep.any():
                parts.append(ids[np.repeat(keep, counts)])
                sizes.append(counts[keep])
        data, vectors = dict(_sparse(total.flush())), {}
        del total
        tidy(caches=False)
        pid = TaskContext.get().partitionId()
        if parts:
            ids, counts = np.concatenate(parts), np.concatenate(sizes)
            del parts
            own = model.copy()
            windows = int((1 + np.maximum(0, counts - 1) // WINDOW).sum())
            own.train(ids, counts, rate=0.1 / (1 + turn), epochs=epochs, batch=min(128, max(8, windows // 64)), seed=pid * ROUNDS + turn)
            vectors = _slices_of(own, inputs_of(ids, counts))
        keys = sorted({*data, *vectors})
        columns = [pa.array(keys, pa.int64()), pa.array([pid // NEAR] * len(keys), pa.int64()), pa.array([data.get(k) for k in keys], pa.binary()), pa.array([vectors.get(k) for k in keys], pa.binary())]
        if keys:
            yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "data", "vector"])

    return run


def _small_of(model: Model) -> np.ndarray:
    """All small tables and their sums of squared gradients in rows of ``DIM`` numbers."""
    small = np.concatenate([t.ravel() for n in SMALL for t in (getattr(model, n), model.sums[n])])
    return np.pad(small, (0, -len(small) % DIM)).reshape(-1, DIM)


def _slices_of(model: Model, seen: np.ndarray) -> dict[int, bytes]:
    """Embeddings of the ids seen and, behind them, all small tables, as weighted rows of ``WIDE`` numbers."""
    weight = np.bincount(seen, minlength=VOCABULARY)
    who, small = np.nonzero(weight)[0], _small_of(model)
    number = np.concatenate([who, VOCABULARY + np.arange(len(small))])
    weight = np.concatenate([weight[who], np.full(len(small), len(seen))]).astype(np.float64)[:, None]
    squares = np.concatenate([model.row_sums[who], np.zeros(len(small))])[:, None]
    rows = np.concatenate([np.concatenate([model.embed[who], small]) * weight, squares * weight, weight], axis=1)
    out = {}
    for s in range(SLICES):
        mine = number % SLICES == s
        if mine.any():
            out[s] = number[mine].astype("<u4").tobytes() + rows[mine].astype("<f8").tobytes()
    return out


def _take_averages(model: Model, vectors) -> None:
    flat = _small_of(model).astype(np.float64)
    for data in vectors:
        number, rows = _rows_of(data)
        mean = rows[:, :-1] / rows[:, -1:]
        is_id = number < VOCABULARY
        model.embed[number[is_id]], model.row_sums[number[is_id]] = mean[is_id, :DIM], mean[is_id, DIM]
        flat[number[~is_id] - VOCABULARY] = mean[~is_id, :DIM]
    flat, at = flat.ravel(), 0
    for name in SMALL:
        size, shape = getattr(model, name).size, getattr(model, name).shape
        setattr(model, name, flat[at : at + size].reshape(shape).astype(np.float32))
        model.sums[name] = flat[at + size : at + 2 * size].reshape(shape).astype(np.float32)
        at += 2 * size


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """Read all texts, and learn from those of the training fold."""
    spark, path = docs.sparkSession, vocabulary_path()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), raw_text(text_col).alias("raw"))
    kind, id_type = rows.schema["id"].dataType.simpleString(), rows.limit(0).select("id").toArrow().schema.field(0).type
    size = text_bytes(docs, text_col)
    head = f"kind int, key long, part long, data binary, id {kind}, train boolean, ids binary, words binary"
    texts = cut(rows.mapInArrow(_read_texts(path, id_type, size), head), "lm-texts")
    sums = _summed(texts.where("kind = 1").select("key", "part", "data", F.lit(None).cast("binary").alias("vector")))
    seen = _dense((v.as_buffer() for v in sums.column("data")), VOCABULARY * 2 * SPREAD).reshape(VOCABULARY, 2 * SPREAD)
    named = texts.where("kind = 2").select("key", "data").groupBy("key").applyInArrow(_frequent(least_count(size)), "key long, data binary").toArrow()
    hot = Hot.of([(k // SLICES, *_named_of(bytes(v.as_buffer()))) for k, v in zip(named.column("key").to_pylist(), named.column("data"))])
    texts = texts.where("kind = 0")

    model, counters = Model(learn_classes(seen)), None
    passes = min(8, max(1, -(-FIRST_IDS // max(1, int(seen[:, :SPREAD].sum())))))
    turns = texts.where("train").select(F.pmod(F.xxhash64("id", F.lit("round")), F.lit(ROUNDS)).alias("turn"), "ids", "words")
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, hot))
        made = (turns if turn == 0 else turns.drop("words")).mapInArrow(_train(shared, turn, -(-passes // ROUNDS), passes > 1), "key long, part long, data binary, vector binary")
        got = _summed(made)
        if turn == 0:
            counters = _dense((v.as_buffer() for v in got.column("data") if v.is_valid), CLASSES * VOCABULARY + int(hot.sizes()[-1]))
        _take_averages(model, [bytes(v.as_buffer()) for v in got.column("vector") if v.is_valid])
    model.set_shares(counters[: CLASSES * VOCABULARY].reshape(CLASSES, VOCABULARY).astype(np.float32))
    return Fitted(model, hot, counters[CLASSES * VOCABULARY :], texts)


# ---- scoring

#: What a block sends to a bucket: words, or phrases.
WORDS, PHRASES = b"w", b"p"


def _by_bucket(keys: np.ndarray, bits: int):
    """Runs of sorted keys by their highest bits: ``(bucket, slice)``."""
    edge = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
    edge = np.concatenate([edge, [len(keys)]])
    for b in np.nonzero(np.diff(edge))[0]:
        yield int(b), slice(edge[b], edge[b + 1])


def _word_rows(keys, doc, train, bits):
    """Distinct words of a block with their training counts, and the documents they are in."""
    if not len(keys):
        return
    words, inverse = np.unique(keys, return_inverse=True)
    pair = np.sort(inverse * len(train) + doc)
    first = np.nonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[0]
    times = np.diff(np.concatenate([first, [len(pair)]]))
    word, doc = np.divmod(pair[first], len(train))
    trained = np.bincount(word, weights=times * train[doc], minlength=len(words)).astype("<u4")
    per_word = np.bincount(word, minlength=len(words)).astype("<u4")
    pair_edge = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
    for b, w in _by_bucket(words, bits):
        p = slice(pair_edge[w.start], pair_edge[w.stop])
        head = np.array([w.stop - w.start, p.stop - p.start, len(train)], "<u4").tobytes()
        yield b, WORDS + head + words[w].astype("<u8").tobytes() + trained[w].tobytes() + per_word[w].tobytes() + doc[p].astype("<u4").tobytes() + times[p].astype("<u4").tobytes()


def _phrase_rows(text, context, phrase, log_prob, train, bits):
    """Phrases of a block with what the block knows of them."""
    learned = train[text]
    own = times_in_group(text, context) * learned
    own_pair = times_in_group(text, pair_keys(context, phrase)) * learned
    order = np.argsort(context, kind="stable")
    columns = [context[order].astype("<u8"), phrase[order].astype("<u4"), text[order].astype("<u4"), own[order].astype("<u4"), own_pair[order].astype("<u4"), log_prob[order].astype("<f4"), learned[order].astype("<u4")]
    for b, p in _by_bucket(columns[0], bits):
        yield b, PHRASES + np.array([p.stop - p.start, len(train)], "<u4").tobytes() + b"".join(c[p].tobytes() for c in columns)


def _hot_gains(hot: Hot, counters, text, context, phrase, log_prob, train, n):
    """Sums by text of the gains of phrases after hot contexts, from the counters of hot keys."""
    edges = hot.sizes()
    at = lookup(hot.contexts, context)
    mine = np.nonzero(at >= 0)[0]
    if not len(mine):
        return np.zeros(n), at >= 0
    text, log_prob, at_hot = text[mine], log_prob[mine], at[mine]
    pair = lookup(hot.pairs, pair_keys(context[mine], phrase[mine]))
    count_pair = counters[edges[2] : edges[3]]
    listed = np.bincount(hot.context_of, weights=count_pair, minlength=len(hot.contexts))  # occurrences that go on as a listed phrase
    kinds = np.bincount(hot.context_of, minlength=len(hot.contexts)) + 1
    learned = train[text]
    own = times_in_group(text, at_hot) * learned
    own_pair = times_in_group(text, np.where(pair >= 0, pair, -1 - at_hot)) * learned
    known = pair >= 0
    own_listed = np.zeros(len(mine), np.int64)  # of the text's own occurrences, those that go on as a listed phrase
    flag = times_in_group(text, at_hot * 2 + known) * learned
    own_listed = np.where(known, flag, own - flag)
    c = counters[edges[1] + at_hot] - own
    p = np.where(known, count_pair[np.maximum(pair, 0)] if len(count_pair) else 0, 0) - np.where(known, own_pair, 0)
    # all phrases that are not listed share what is left with the attention model
    whole = np.maximum(c, 0) + kinds[at_hot]
    rest = (c - (listed[at_hot] - own_listed) + kinds[at_hot]) / whole
    told = np.maximum(p, 0) / whole
    with np.errstate(divide="ignore"):
        a, b = np.log10(np.maximum(rest, 1e-12)), np.log10(told) - log_prob
    high = np.maximum(a, b)
    gain = np.where(c > 0, high + np.log10(10.0 ** (a - high) + 10.0 ** (b - high)), 0.0)
    return np.bincount(text, weights=gain, minlength=n), at >= 0


def _blocks(batches):
    """Documents in blocks of about ``BLOCK_IDS`` ids."""
    held, size, docs = [], 0, 0
    for batch in parts_of(batches, 512):
        n = pc.sum(pc.binary_length(batch.column("ids"))).as_py() or 0
        if held and (size + n // 2 > BLOCK_IDS or docs + batch.num_rows > BLOCK_DOCS):
            yield pa.Table.from_batches(held)
            held, size, docs = [], 0, 0
        held.append(batch)
        size, docs = size + n // 2, docs + batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


HEAD = ["bucket", "block", "place", "id", "train", "n_tokens", "score", "logs", "known", "data"]


def _score(shared, buckets, id_type):
    """Rows of documents with what their block knows, and rows of words and phrases by bucket."""
    bits = buckets.bit_length() - 1

    def run(batches):
        tidy()
        model, hot, counters = shared.value
        logs_of = np.log10(counters[: len(hot.words)] + 1.0)
        pid = TaskContext.get().partitionId()
        for number, table in enumerate(_blocks(batches)):
            block, n = (pid << 32) + number, table.num_rows
            train = table.column("train").to_numpy()
            ids, counts = _flat(table.column("ids"), np.uint16)
            words, n_words = _flat(table.column("words"), np.uint64)
            places, doc = lookup(hot.words, words), np.repeat(np.arange(n), n_words)
            is_hot = places >= 0
            rare, rare_doc, places, doc = words[~is_hot], doc[~is_hot], places[is_hot], doc[is_hot]
            lp = np.concatenate([model.log_probs(i, c) for i, c in _runs(ids, counts)]).astype(np.float64)
            sums = np.concatenate([[0.0], np.cumsum(lp)])
            ends = np.cumsum(counts)
            text, start, end, context, phrase = cut_phrases(ids, counts)
            log_prob = sums[end] - sums[start]
            gain, done = _hot_gains(hot, counters, text, context, phrase, log_prob, train, n)
            known = np.bincount(doc, weights=counters[places] > 0, minlength=n).astype(np.int64)
            logs = np.bincount(doc, weights=logs_of[places], minlength=n) if len(places) else np.zeros(n)
            docs = [np.full(n, (pid + number) % buckets), np.full(n, block), np.arange(n), table.column("id"), table.column("train"), n_words + 1, sums[ends] - sums[ends - counts] + gain, logs, known, pa.nulls(n, pa.binary())]
            docs = [pa.array(c) if isinstance(c, np.ndarray) else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in docs]
            yield pa.RecordBatch.from_arrays(docs, names=HEAD)
            rest = ~done
            rows = [*_word_rows(rare, rare_doc, train, bits), *_phrase_rows(text[rest], context[rest], phrase[rest], log_prob[rest], train, bits)]
            m = len(rows)
            if m:
                empty = [pa.nulls(m, k) for k in (id_type, pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array(np.full(m, block)), pa.array(np.full(m, -1)), *empty, pa.array([d for _, d in rows], pa.binary())], names=HEAD)
        tidy(caches=False)

    return run


def _runs(ids, counts, size: int = 400_000):
    """Whole texts in runs of about ``size`` ids."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        base = ends[at] - counts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield ids[base : ends[to - 1]], counts[at:to]
        at = to


def _words_of_bucket(parts):
    """Per part: known words and sums of log10(count + 1) by document; and all occurrences and distinct words."""
    read = []
    for raw in parts:
        n, p, d = (int(x) for x in np.frombuffer(raw, "<u4", 3, 1))
        read.append((d, np.frombuffer(raw, "<u8", n, 13), np.frombuffer(raw, "<u4", n, 13 + 8 * n), np.frombuffer(raw, "<u4", n, 13 + 12 * n), np.frombuffer(raw, "<u4", p, 13 + 16 * n), np.frombuffer(raw, "<u4", p, 13 + 16 * n + 4 * p)))
    distinct, where = np.unique(np.concatenate([r[1] for r in read]), return_inverse=True)
    count = np.bincount(where, weights=np.concatenate([r[2] for r in read]), minlength=len(distinct))
    log, at, out = np.log10(count + 1), 0, []
    for d, keys, _, per_word, doc, times in read:
        own = np.repeat(where[at : at + len(keys)], per_word)
        at += len(keys)
        known = np.bincount(doc, weights=times * (count[own] > 0), minlength=d)
        sums = np.bincount(doc, weights=times * log[own], minlength=d)
        met = np.nonzero(known)[0]  # no known word: nothing to add
        out.append(WORDS + met.astype("<u4").tobytes() + known[met].astype("<u4").tobytes() + sums[met].astype("<f8").tobytes())
    return out, int(count.sum()), int((count > 0).sum())


def _phrases_of_bucket(parts):
    """Per part: sums of gains by document."""
    read, kinds = [], ("<u8", "<u4", "<u4", "<u4", "<u4", "<f4", "<u4")
    for raw in parts:
        n, d = (int(x) for x in np.frombuffer(raw, "<u4", 2, 1))
        at, columns = 9, []
        for k in kinds:
            columns.append(np.frombuffer(raw, k, n, at))
            at += columns[-1].nbytes
        read.append((d, columns))
    context, phrase, _, own, own_pair, log_prob, learned = (np.concatenate([c[i] for _, c in read]) for i in range(len(kinds)))
    _, c_at = np.unique(context, return_inverse=True)
    key, p_at = np.unique(pair_keys(context, phrase), return_inverse=True)
    c = np.bincount(c_at, weights=learned).astype(np.int64)
    p = np.bincount(p_at, weights=learned).astype(np.int64)
    owner = np.zeros(len(key), np.int64)
    owner[p_at] = c_at
    t = np.bincount(owner, weights=p > 0, minlength=len(c)).astype(np.int64)
    # without the text's own occurrences
    alone = (own_pair > 0) & (own_pair == p[p_at])
    gain = gains(log_prob.astype(np.float64), c[c_at] - own, p[p_at] - own_pair, t[c_at] - alone)
    out, at = [], 0
    for d, columns in read:
        n = len(columns[0])
        sums = np.bincount(columns[2], weights=gain[at : at + n], minlength=d)
        at += n
        met = np.nonzero(sums)[0]
        out.append(PHRASES + met.astype("<u4").tobytes() + sums[met].astype("<f8").tobytes())
    return out


_GROUPS = [0]


def _tidy_now_and_then() -> None:
    """Give memory back at a worker's first group and every 64 after it: groups are small, and giving back takes its time."""
    if _GROUPS[0] % 64 == 0:
        tidy()
    _GROUPS[0] += 1


def _bucket(table: pa.Table) -> pa.Table:
    """Counts of a bucket's words and phrases; what they add to the documents of every block."""
    _tidy_now_and_then()
    is_doc = table.column("data").is_null()
    docs, sent = table.filter(is_doc), table.filter(pc.invert(is_doc))
    names = [n for n in HEAD if n not in ("bucket", "data")]
    out = [docs.select(names).append_column("data", pa.nulls(docs.num_rows, pa.binary())).append_column("n", pa.nulls(docs.num_rows, pa.int64())).append_column("v", pa.nulls(docs.num_rows, pa.int64()))]
    if sent.num_rows:
        raw = [bytes(v.as_buffer()) for v in sent.column("data")]
        words, phrases = ([i for i, r in enumerate(raw) if r[:1] == k] for k in (WORDS, PHRASES))
        data, n, v = [None] * len(raw), 0, 0
        if words:
            found, n, v = _words_of_bucket([raw[i] for i in words])
            for i, d in zip(words, found):
                data[i] = d
        if phrases:
            for i, d in zip(phrases, _phrases_of_bucket([raw[i] for i in phrases])):
                data[i] = d
        zero = [0] * (len(raw) - 1)
        more = sent.select(names).append_column("data", pa.array(data, pa.binary()))
        out.append(more.append_column("n", pa.array([n, *zero], pa.int64())).append_column("v", pa.array([v, *zero], pa.int64())))
    return pa.concat_tables(out)


def _block(table: pa.Table) -> pa.Table:
    """A block's documents with the sums that the buckets sent."""
    _tidy_now_and_then()
    is_doc = table.column("data").is_null()
    docs, sent = table.filter(is_doc), table.filter(pc.invert(is_doc))
    n = docs.num_rows
    logs, gain, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for value in sent.column("data"):
        raw = bytes(value.as_buffer())
        if raw[:1] == WORDS:
            m = len(raw) // 16
            met = np.frombuffer(raw, "<u4", m, 1)
            known[met] += np.frombuffer(raw, "<u4", m, 1 + 4 * m)
            logs[met] += np.frombuffer(raw, "<f8", m, 1 + 8 * m)
        else:
            m = len(raw) // 12
            gain[np.frombuffer(raw, "<u4", m, 1)] += np.frombuffer(raw, "<f8", m, 1 + 4 * m)
    place = docs.column("place").to_numpy()
    columns = {"score": docs.column("score").to_numpy() + gain[place], "logs": docs.column("logs").to_numpy() + logs[place], "known": docs.column("known").to_numpy() + known[place]}
    out = docs.select(["id", "train", "n_tokens"])
    for name, values in columns.items():
        out = out.append_column(name, pa.array(values))
    return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    model, hot, counters, texts = fit(docs, train, id_col, text_col)
    shared = spark.sparkContext.broadcast((model, hot, counters))
    buckets = 1 << max(0, (-(-text_bytes(docs, text_col) // bucket_bytes) - 1).bit_length())
    kind, id_type = texts.schema["id"].dataType.simpleString(), texts.limit(0).select("id").toArrow().schema.field(0).type
    head = f"block long, place long, id {kind}, train boolean, n_tokens long, score double, logs double, known long, data binary"
    dealt = texts.select("id", "train", "ids", "words").mapInArrow(_score(shared, buckets, id_type), f"bucket long, {head}")
    sums = cut(dealt.groupBy("bucket").applyInArrow(_bucket, f"{head}, n long, v long"), "lm-sums")
    n, v, ends = sums.agg(F.sum("n"), F.sum("v"), F.count_if("train")).first()
    hot_counts = counters[: len(hot.words)]
    n, v = (n or 0) + ends + int(hot_counts.sum()), (v or 0) + (1 if ends else 0) + int((hot_counts > 0).sum())
    got = sums.drop("n", "v").groupBy("block").applyInArrow(_block, f"id {kind}, train boolean, n_tokens long, score double, logs double, known long")
    end_known = 1 if ends else 0
    base = F.col("logs") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return got.select("id", "train", "n_tokens", (F.col("known") + end_known).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
