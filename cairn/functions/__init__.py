"""Column functions, in one place."""

from cairn.operators.addresses import hex_text, parse_address
from cairn.operators.linkage import arity, is_platform
from cairn.operators.similarity import abstained, agreeing, jaccard, shape, weighted
from cairn.operators.text import distinct_sorted, latin1, ngrams, once, printable_runs, short_hash, sniff, words

__all__ = [
    "abstained",
    "agreeing",
    "arity",
    "distinct_sorted",
    "hex_text",
    "is_platform",
    "jaccard",
    "latin1",
    "ngrams",
    "once",
    "parse_address",
    "printable_runs",
    "shape",
    "short_hash",
    "sniff",
    "weighted",
    "words",
]
