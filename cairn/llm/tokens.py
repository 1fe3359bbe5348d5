"""Token ids of whole texts with a public tokenizer file.

The tokenizer drops white space, never joins across it, and splits between
letters, digits and other characters (an apostrophe may join the letter after
it).  A text's ids are thus those of its units one after another.  Every worker
keeps the ids of the units it has met (beyond ``REMEMBERED`` the rare ones go), encodes new ones
with the tokenizers library, and gathers the ids of whole blocks of text with
numpy.  In texts of ASCII and Latin letters a unit is a run of one character
class; in any other text it is a whole run between ASCII white space.

Units are recognised by 96 bits of hash; longer ones than ``LONGEST`` bytes are
kept by their bytes.  Ids are held as little-endian unsigned 16-bit integers
(the vocabulary has fewer than 65,536 entries; larger ones raise ``ValueError``).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import CACHES, parts_of, raw_text, tidy
from cairn.llm.hashing import HashTable, run_hashes

END = 2
#: Units a worker remembers before it lets rare ones go, bytes of text taken at once, longest hashed unit.
REMEMBERED = 1_000_000
AT_ONCE = 1 << 20
LONGEST = 96
#: Bytes beyond ASCII text and Latin letters (U+00C0 to U+017F without signs and U+0130), and special tokens.
COMPLEX = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xc2\xc6-\xff]|\xc3[\x97\xb7]|\xc4\xb0|<\|")
SPACE, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KIND[0x30:0x3A] = DIGIT
PLAIN = np.where(KIND == SPACE, SPACE, LETTER).astype(np.uint8)
_BREAK = "\x01"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(x: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of a block of bytes."""
    kind = (KIND if split else PLAIN)[x]
    new = np.empty(len(x), bool)
    new[:1] = True
    new[1:] = kind[1:] != kind[:-1]
    if split:
        new |= kind == DIGIT
        new[1:] &= ~((x[:-1] == 0x27) & (kind[1:] == LETTER))
    edge = np.concatenate([np.nonzero(new)[0], [len(x)]])
    solid = kind[edge[:-1]] != SPACE
    return edge[:-1][solid], edge[1:][solid]


class UnitIds:
    """Ids of units, remembered in flat arrays."""

    def __init__(self, path: str, end: int = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        marks = self.tokenizer.encode(_BREAK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None
        self.clear()

    def clear(self):
        self.table, self.long = HashTable(), {}
        self.flat, self.used = np.zeros(1 << 18, np.uint16), 0
        self.starts, self.lens, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.hits, self._numbers = np.zeros(1 << 16, np.int32), np.array([-1], np.int32)

    def forget(self):
        """Keep the units that have come up again, as many as fill half of the room, and their halved hits."""
        t = self.table
        slot = np.nonzero(t.value >= 0)[0]
        unit = self._numbers[t.value[slot]]
        often = np.argsort(-self.hits[unit], kind="stable")[: REMEMBERED // 2]
        often = often[self.hits[unit[often]] > 1]
        slot, unit = slot[often], unit[often]
        key, check, hits = t.key[slot], t.check[slot], self.hits[unit] // 2
        lens = self.lens[unit].astype(np.int64)
        ends = np.cumsum(lens)
        flat = self.flat[np.repeat(self.starts[unit] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        self.clear()
        self._keep(flat, lens)
        self.hits[: self.n] = hits
        self.table.add(key, check)
        self._numbers = np.append(np.arange(self.n), -1).astype(np.int32)

    def _keep(self, flat: np.ndarray, lens: np.ndarray) -> None:
        """Append units by their ids."""
        n = len(lens)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.lens):
            for name in ("lens", "starts", "hits"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.flat[self.used : self.used + len(flat)] = flat
        self.lens[self.n : self.n + n] = lens
        self.starts[self.n : self.n + n] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.n += n

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        if self.mark is not None and not any(_BREAK in w for w in words):
            out = []
            for at in range(0, len(words), 1000):
                some = words[at : at + 1000]
                ids = np.array(self.tokenizer.encode(f" {_BREAK} ".join(some), add_special_tokens=False).ids, np.uint16)
                cuts = np.nonzero(ids == self.mark)[0]
                if len(cuts) != len(some) - 1:
                    break
                edge = np.concatenate([[-1], cuts, [len(ids)]])
                out.append((ids, edge))
            else:
                return out
        lists = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [(ids, np.array([-1, len(ids)])) for ids in lists]

    def learn(self, words: list[bytes]) -> None:
        """Encode new units and append them in order."""
        for ids, edge in self._encode([w.decode("utf-8", "replace") for w in words]):
            lens = np.diff(edge) - 1
            keep = np.ones(len(ids), bool)
            keep[edge[1:-1]] = False
            self._keep(ids[keep], lens)

    def encode(self, raw: bytes, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block, and for each unit its start in the block and where its ids end."""
        if self.n > REMEMBERED:
            self.forget()
        x = np.frombuffer(raw, np.uint8)
        starts, ends = units(x, split)
        if not len(starts):
            return np.empty(0, np.uint16), starts, starts
        key, check = run_hashes(x, starts, ends)
        at = self._numbers[self.table.find(key, check)]
        size = ends - starts
        far = np.nonzero(size > LONGEST)[0]
        at[far] = -1
        fresh = np.nonzero((at < 0) & (size <= LONGEST))[0]
        if len(fresh):
            _, first = np.unique(key[fresh], return_index=True)
            first = fresh[np.sort(first)]
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            numbers = np.arange(self.n, self.n + len(words))
            self.learn(words)
            self.table.add(key[first], check[first])
            self._numbers = np.concatenate([self._numbers[:-1], numbers, [-1]]).astype(np.int32)
            at[fresh] = self._numbers[self.table.find(key[fresh], check[fresh])]
        for i in far:
            word = raw[starts[i] : ends[i]]
            if word not in self.long:
                self.long[word] = self.n
                self.learn([word])
            at[i] = self.long[word]
        self.hits[: self.n] += np.bincount(at, minlength=self.n).astype(np.int32)
        lens = self.lens[at].astype(np.int64)
        done = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[at] - (done - lens), lens) + np.arange(done[-1])]
        return ids, starts, done


@lru_cache(maxsize=2)
def unit_ids(path: str, end: int = END) -> UnitIds:
    return UnitIds(path, end)


CACHES.append(unit_ids.cache_clear)


def pieces(raw: bytes, size: int = AT_ONCE):
    """A text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while len(raw) - at > size:
        cut = max(raw.rfind(b" ", at, at + size), raw.rfind(b"\n", at, at + size))
        if cut <= at:
            cut = min((x for x in (raw.find(b" ", at + size), raw.find(b"\n", at + size)) if x > 0), default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


#: ASCII that is plain wherever it stands; without it the bytes of other letters stay side by side.
_ASCII = bytes(c for c in range(0x80) if not COMPLEX.match(bytes([c])))


def _plain(raws: list[bytes]) -> bool:
    return not any(b"<|" in r or COMPLEX.search(r.translate(None, _ASCII)) for r in raws)


def encoded(raws: list[bytes], path: str, end: int = END):
    """Yield ``(first, last, ids, counts)`` for runs of texts; each text's ids end with the end id."""
    book = unit_ids(path, end)
    i = 0
    while i < len(raws):
        split = _plain(raws[i : i + 1])
        if len(raws[i]) > AT_ONCE:
            parts = [book.encode(p.lower() if split else p, split)[0] for p in pieces(raws[i])]
            ids = np.concatenate([*parts, np.array([end], np.uint16)])
            yield i, i + 1, ids, np.array([len(ids)])
            i += 1
            continue
        j, size = i, 0
        while j < len(raws) and size + len(raws[j]) <= AT_ONCE and (j == i or _plain(raws[j : j + 1]) == split):
            size += len(raws[j]) + 1
            j += 1
        block = b"\n".join(raws[i:j])
        ids, starts, done = book.encode(block.lower() if split else block, split)
        limits = np.cumsum([len(r) + 1 for r in raws[i:j]])
        ends = np.concatenate([[0], done])[np.searchsorted(starts, limits)]
        counts = np.diff(np.concatenate([[0], ends])) + 1
        yield i, j, np.insert(ids, ends, np.uint16(end)), counts
        i = j


def _run(path, end):
    def run(batches):
        for batch in parts_of(batches):
            raws = batch.column(batch.num_columns - 1).to_pylist()
            for i, j, ids, counts in encoded(raws, path, end):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 2
                binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                kept = [c.slice(i, j - i) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts), binary], names=[*batch.schema.names[:-1], "n", "ids"])
        tidy(caches=False)

    return run


def tokenize(docs: DataFrame, keys: list[str], text_col: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """``keys..., n, ids`` for every row: the ids of the whole text and then ``end``."""
    path = path or vocabulary_path()
    rows = docs.select(*keys, raw_text(text_col).alias("raw"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_run(path, end), f"{fields}, n long, ids binary")
