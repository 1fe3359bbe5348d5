"""Phrases: what the whole corpus says comes after the last few ids, for language-model scores.

A text's ids are cut into phrases at places that the three ids before them choose
(about one in ``EVERY``) and after ``LONGEST`` ids.  Where a phrase starts, the
``ORDER`` ids before it are its context.  The corpus remembers for every context
which phrases followed it in training texts, and how often; a text's own
occurrences do not count for it.  With ``c`` occurrences of a context, ``p`` of
them going on as the phrase does, and ``t`` distinct phrases,

    P(phrase) = t / (c + t) * P_attention(phrase) + p / (c + t)

so that the attention model is all there is where a context is new, and a text of
which another copy was learned from is told apart.  Phrases follow from the ids
before their ends, so these probabilities add up to one.
"""

from __future__ import annotations

import numpy as np

from cairn.llm.hashing import mix, run_hashes

ORDER, EVERY_BITS, LONGEST = 8, 5, 64
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def cut_phrases(ids: np.ndarray, counts: np.ndarray):
    """``text, start, end, context, phrase`` of every phrase that has a context (hashes: 64 and 32 bits)."""
    none = np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    firsts = ends - counts
    if len(ids) <= ORDER:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint32)
    wide = ids.astype(np.uint32)
    hashed = wide[2:-1] * _A + wide[1:-2] * _B + wide[:-3] * _C
    hashed ^= hashed >> np.uint32(15)
    chosen = np.nonzero((hashed * _B) >> np.uint32(32 - EVERY_BITS) == 0)[0] + 3
    text = np.searchsorted(ends, chosen, side="right")
    inside = chosen - firsts[text] >= ORDER
    chosen, text = chosen[inside], text[inside]
    if not len(chosen):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint32)
    until = ends[text]
    until[:-1] = np.where(text[1:] == text[:-1], chosen[1:], until[:-1])
    parts = -(-(until - chosen) // LONGEST)
    at = np.repeat(np.arange(len(chosen)), parts)
    start = chosen[at] + LONGEST * (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(start + LONGEST, until[at])
    (found,) = run_hashes(ids, np.concatenate([start - ORDER, start]), np.concatenate([start, end]), 1)
    return text[at], start, end, found[: len(start)], (found[len(start) :] >> np.uint64(32)).astype(np.uint32)


def pair_keys(context: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """One key for a context together with the phrase after it."""
    return mix(context + phrase.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def times_in_group(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each entry, how many entries of the same text have the same key."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.lexsort((key, text))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])])
    group = np.cumsum(new) - 1
    out = np.empty(len(key), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def gains(log_prob: np.ndarray, context: np.ndarray, phrase: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Log10 of the mixed probability over the attention model's: counts of contexts, phrases there, distinct phrases."""
    c, p, t = context.astype(np.float64), phrase.astype(np.float64), np.maximum(distinct, 1).astype(np.float64)
    rest = np.log10(t / (c + t))
    with np.errstate(divide="ignore"):
        told = np.log10(p / (c + t)) - log_prob
    high = np.maximum(rest, told)
    mixed = high + np.log10(10.0 ** (rest - high) + 10.0 ** (told - high))
    return np.where(c > 0, np.where(p > 0, mixed, rest), 0.0)
