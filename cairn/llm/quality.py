"""Quality classifier: a factorisation machine.

Inputs of a text: hashed words (bytes between ASCII white space, lower-cased
A-Z, count-scaled and length-normalised), structure statistics cut into bins,
and metadata columns cut into bins.  The score is
``w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``,
linear in the number of inputs, through a logistic function.

Fitting uses a bounded sample: the ``SAMPLE`` labelled training rows with the
smallest hash of their id; labels come from their own table.

Defined cases: a null text counts as empty and gets the score of an empty text;
null metadata has a bin of its own; rows without a label, or with a null one,
are scored but not learned from; without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import raw_text, tidy, values

BITS = 16
RANK = 8
SAMPLE = 6000
BINS = 16
#: Character classes of the structure statistics.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r", b".,;:'\"-()", b"#$%&*@^~", b"!?", b"|<>{}[]\\/=_+")
CLASS_OF = np.full(256, len(CLASSES))
for _i, _chars in enumerate(CLASSES):
    CLASS_OF[list(_chars)] = _i
N_STATS = len(CLASSES) + 1 + 7
EDGES = np.array([0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 0.97])


def statistics(raw: bytes, words: list, counts: Counter) -> np.ndarray:
    """Structure statistics of a text, each a number that ``EDGES`` cut into bins."""
    size, n = max(1, len(raw)), max(1, len(words))
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(CLASS_OF, weights=chars, minlength=len(CLASSES) + 1) / size
    lines = raw.split(b"\n")
    longest = max(map(len, lines))
    more = (
        len(counts) / n,
        (max(counts.values()) if counts else 0) / n,
        1 - len(set(lines)) / len(lines),
        len(lines) / n,
        min(1.0, sum(map(len, words)) / n / 20),
        min(1.0, np.log1p(longest) / 12),
        min(1.0, np.log1p(len(raw)) / 14),
    )
    return np.concatenate([shares, more])


def features(raw: bytes, metadata=()) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the text's inputs; ``metadata``: numbers or None."""
    words = raw.lower().split()
    counts = Counter(words)
    at = np.fromiter(map(crc32, counts), np.int64, len(counts)) & ((1 << BITS) - 1)
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(value):
        value *= 1 / np.sqrt(value @ value)
    stats = np.searchsorted(EDGES, statistics(raw, words, counts), side="right")
    bins = [1 + int(np.searchsorted(EDGES, min(1.0, np.log1p(abs(m)) / 14), side="right")) if m is not None and m == m else 0 for m in metadata]
    own = (1 << BITS) + np.concatenate([np.arange(N_STATS) * BINS + stats, N_STATS * BINS + np.arange(len(bins)) * (BINS + 1) + np.array(bins, int)]).astype(np.int64)
    return np.concatenate([at, own]), np.concatenate([value, np.full(len(own), 0.35)])


class Machine:
    def __init__(self, n_metadata: int):
        self.size = (1 << BITS) + N_STATS * BINS + n_metadata * (BINS + 1)
        self.bias, self.linear = 0.0, np.zeros(self.size)
        self.pairs = np.random.default_rng(11).normal(0, 0.02, (self.size, RANK))

    def raw_score(self, at, x) -> float:
        v = self.pairs[at]
        s = x @ v
        return self.bias + x @ self.linear[at] + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1))

    def score(self, raw: bytes, metadata=()) -> float:
        z = self.raw_score(*features(raw, metadata))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, rows, labels, epochs=5, rate=0.1, reg=1e-4):
        """Adagrad on the logistic loss."""
        rng = np.random.default_rng(5)
        g_bias, g_linear, g_pairs = 1e-6, np.full(self.size, 1e-6), np.full((self.size, RANK), 1e-6)
        share = np.clip(np.mean(labels), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                x = x.astype(np.float64)
                v = self.pairs[at]
                s = x @ v
                z = self.bias + x @ self.linear[at] + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1))
                d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
                g_bias += d * d
                self.bias -= rate * d / np.sqrt(g_bias)
                g = d * x + reg * self.linear[at]
                g_linear[at] += g * g
                self.linear[at] -= rate * g / np.sqrt(g_linear[at])
                g = d * (x[:, None] * (s - x[:, None] * v)) + reg * v
                g_pairs[at] += g * g
                self.pairs[at] -= 0.5 * rate * g / np.sqrt(g_pairs[at])
        self.linear, self.pairs = self.linear.astype(np.float32), self.pairs.astype(np.float32)
        return self


def _sample_features(n_metadata):
    def run(batches):
        for batch in batches:
            got = [features(r[0], r[2:]) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([a for a, _ in got], pa.list_(pa.int64())), pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))],
                names=["label", "at", "x"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, train, id_col="doc_id", text_col="text", label_col="quality", metadata=("n_chars",), sample=SAMPLE) -> Machine | None:
    """Learn from labelled rows where ``train`` holds; ``sample`` bounds them."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    chosen = marked.where(train).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    extra = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]
    rows = docs.select(F.col(id_col), raw_text(text_col).alias("raw"), *extra).join(chosen, id_col)
    got = (
        rows.select("raw", "__label", *[f"m{i}" for i in range(len(metadata))])
        .mapInArrow(_sample_features(len(metadata)), "label int, at array<long>, x array<float>")
        .toArrow()
    )
    if not got.num_rows:
        return None
    at, x = (got.column(c).combine_chunks() for c in ("at", "x"))
    cuts = at.offsets.to_numpy()
    at, x, y = at.values.to_numpy(), x.values.to_numpy(), got.column("label").to_numpy()
    rows = [(at[a:b], x[a:b]) for a, b in zip(cuts, cuts[1:])]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i][0]), rows[i][0].tobytes()))
    machine = Machine(len(metadata)).fit([rows[i] for i in order], [int(y[i] > 0) for i in order])
    del got, at, x, rows
    tidy()
    return machine


def scorer(spark, machine: Machine | None):
    """A column function: UTF-8 text and metadata columns to the score."""
    shared = spark.sparkContext.broadcast(machine)

    @F.arrow_udf(T.DoubleType())
    def score(raw: pa.Array, *metadata: pa.Array) -> pa.Array:
        m = shared.value
        rows = zip(values(raw), *(c.to_pylist() for c in metadata))
        got = pa.array([0.5 if m is None else m.score(r[0] or b"", r[1:]) for r in rows], pa.float64())
        tidy()
        return got

    return score
