"""Language identification by hierarchical discrimination.

A first linear classifier set chooses the language family; inside the family
one-versus-one linear support vector machines separate the related languages
by voting.  Inputs are hashed byte 3- and 4-grams of the lower-cased letters of
the whole text, as relative frequencies.  Each machine weighs a gram by its
smoothed log ratio between the two sides times a factor learned by hinge-loss
descent; a score is a sum of table look-ups over the text divided by the
number of grams, so time is linear and memory constant.

Fitting uses a bounded sample: about ``PER_LANG`` documents of each
labelled language (a share of each, drawn by the hash of the
id) together with short pieces of them.

Defined cases: a null text or one without any letter is ``und`` with score 0;
null languages are not learned from; with a single learned language all
lettered texts get it with score 1; with none they are ``und``; ties take the
alphabetically first language.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import tidy, values

BITS = 16
PER_LANG = 400
UNDETERMINED = "und"
#: Families of common ISO 639-1 codes; any other code is its own family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = re.compile(r"[^\W\d_]")
KEEP = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Table rows of the text's 3- and 4-grams; runs of other characters count as one space."""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(KEEP).split())
    x = np.frombuffer(b" " + raw + b"  ", np.uint8).astype(np.uint32)
    tri = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    four = (tri[:-1] << np.uint32(8)) | x[3:]
    both = np.concatenate([tri * np.uint32(0x85EBCA6B), four * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)])
    return (both >> np.uint32(32 - BITS)).astype(np.int64)


def _sample_features(batches):
    """Gram counts of whole sample texts and of short pieces of them."""
    for batch in batches:
        out = {"lang": [], "gram": [], "count": []}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text.split()
            pieces = [text] + [" ".join(words[at : at + size]) for at, size in ((0, 2), (len(words) // 2, 4), (len(words) // 3, 12))]
            for piece in pieces:
                if LETTER.search(piece):
                    gram, count = np.unique(grams(piece), return_counts=True)
                    out["lang"].append(lang)
                    out["gram"].append(gram.astype(np.int32))
                    out["count"].append(count.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["lang"], pa.string()), pa.array(out["gram"], pa.list_(pa.int32())), pa.array(out["count"], pa.list_(pa.int32()))],
            names=list(out),
        )


def _machine(rows, sign, epochs=6, reg=1e-3):
    """One linear machine over gram frequencies: log ratios times learned factors."""
    size = 1 << BITS
    mass = np.ones((2, size))
    for (gram, freq), s in zip(rows, sign):
        mass[int(s > 0)][gram] += freq * 50
    ratio = np.log(mass[1] / mass[1].sum()) - np.log(mass[0] / mass[0].sum())
    factor, bias, rng, total, sums = np.ones(size), 0.0, np.random.default_rng(7), 0, np.zeros(size)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).mean() * 1.0), 0.5 / max(1e-9, (sign <= 0).mean()))
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for i in rng.permutation(len(rows)):
            gram, freq = rows[i]
            x = freq * ratio[gram]
            if sign[i] * (x @ factor[gram] + bias) < 1:
                factor[gram] += rate * weight[i] * sign[i] * x
                bias += 0.02 * rate * weight[i] * sign[i]
        factor += rate * reg * (1 - factor)
        if epoch >= epochs // 2:
            sums += factor
            total += 1
    return ratio * sums / total, bias


class Model:
    """Tables of all machines side by side, and how their outcomes combine."""

    def __init__(self, langs, rows=(), labels=()):
        self.langs = sorted(langs)
        self.families = sorted({FAMILY.get(x, x) for x in self.langs})
        self.members = {f: [x for x in self.langs if FAMILY.get(x, x) == f] for f in self.families}
        labels = np.array(labels, dtype=object)
        machines = []
        of = np.array([FAMILY.get(x, x) for x in labels], dtype=object)
        self.family_machines = [] if len(self.families) < 2 else self.families[: 1 if len(self.families) == 2 else None]
        for family in self.family_machines:
            machines.append(_machine(rows, np.where(of == family, 1, -1)))
        self.pairs = [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        for _, a, b in self.pairs:
            keep = np.nonzero((labels == a) | (labels == b))[0]
            machines.append(_machine([rows[i] for i in keep], np.where(labels[keep] == a, 1, -1)))
        self.table = np.stack([m[0] for m in machines], axis=1).astype(np.float32) if machines else None
        self.bias = np.array([m[1] for m in machines])

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNDETERMINED, 0.0
        if self.table is None:
            return self.langs[0], 1.0
        total, n, at = np.zeros(self.table.shape[1]), 0, 0
        found = grams(text)
        while at < len(found):
            total += self.table[found[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
            at += 1 << 16
        n = len(found)
        margin = total / n + self.bias
        k = len(self.family_machines)
        if k == 0:
            family, sure = self.families[0], 50.0
        elif k == 1:
            family, sure = self.families[0 if margin[0] >= 0 else 1], abs(margin[0])
        else:
            best = int(np.argmax(margin[:k]))
            family, sure = self.families[best], margin[best]
        votes = dict.fromkeys(self.members[family], 0)
        for (f, a, b), m in zip(self.pairs, margin[k:]):
            if f == family:
                votes[a if m >= 0 else b] += 1
        lang = max(self.members[family], key=lambda x: votes[x])
        for (f, a, b), m in zip(self.pairs, margin[k:]):
            if f == family and lang in (a, b):
                sure = min(sure, m if lang == a else -m)
        return lang, float(1 / (1 + np.exp(-4 * np.clip(sure, -10, 10))))


def fit(docs: DataFrame, train, text_col="text", lang_col="lang", id_col="doc_id", per_lang=PER_LANG) -> Model:
    """Learn from the rows where ``train`` holds; every language with rows is learned, from about ``per_lang`` of them."""
    pool = docs.where(train & F.col(lang_col).isNotNull())
    found = pool.where(F.col(text_col).isNotNull()).groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in found.orderBy(F.desc("n"), lang_col).collect()}
    langs = list(counts)
    if not langs:
        return Model([])
    # a share of each language, by the hash of the id: no shuffle, about ``per_lang`` rows
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))]), F.col(lang_col))
    drawn = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    chosen = pool.where(F.col(text_col).isNotNull() & F.col(lang_col).isin(langs) & (drawn < share)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = chosen.mapInArrow(_sample_features, "lang string, gram array<int>, count array<int>").toArrow()
    rows, labels = [], []
    gram, count = (sample.column(c).combine_chunks() for c in ("gram", "count"))
    cuts, gram, count = gram.offsets.to_numpy(), gram.values.to_numpy(), count.values.to_numpy()
    pieces = sorted(zip(sample.column("lang").to_pylist(), cuts, cuts[1:]), key=lambda r: (r[0], r[2] - r[1], gram[r[1] : r[2]].tobytes()))
    for lang, a, b in pieces:
        rows.append((gram[a:b], (count[a:b] / count[a:b].sum()).astype(np.float32)))
        labels.append(lang)
    model = Model(set(labels), rows, labels)
    del sample, rows, gram, count
    tidy()
    return model


def predictor(spark, model: Model):
    """A column function: text to ``struct<lang_pred, score>``."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        got = [shared.value.predict(t) for t in values(texts)]
        tidy()
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"]
        )

    return predict
