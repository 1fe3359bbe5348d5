"""Set and shape similarity in which missing evidence abstains (null) instead of counting as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the signals of a match.
WEIGHTS = {"strings": 0.30, "imports": 0.25, "constants": 0.15, "ngrams": 0.20, "signature": 0.05, "shape": 0.05}
#: Signals that count as content when agreement is asked for, and the level of agreement.
CONTENT = ("strings", "imports", "constants", "ngrams")
AGREES = 0.5
#: Weights of the counters of a shape.
SHAPE = (0.4, 0.3, 0.2, 0.1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets (arrays): null if both are empty, 0 if one is."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return shared / F.nullif(every, F.lit(0))


def shape(pairs: list[tuple[Column, Column]], weights=SHAPE) -> Column:
    """Weighted closeness of counters: ``1 - |x - y| / max(x, y, 1)`` each."""
    parts = [w * F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(x, y, F.lit(1))) for w, (x, y) in zip(weights, pairs)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def weighted(components: dict[str, Column], weights: dict[str, float] = WEIGHTS, digits: int = 4) -> Column:
    """Mean of the components that do not abstain, by weight, rounded; null if all abstain."""
    def add(columns):
        total = F.lit(0.0)
        for c in columns:
            total = total + c
        return total

    value = add(F.coalesce(c * weights[n], F.lit(0.0)) for n, c in components.items())
    weight = add(F.when(c.isNotNull(), weights[n]).otherwise(0.0) for n, c in components.items())
    return F.round(value / F.nullif(weight, F.lit(0.0)), digits)


def agreeing(components: dict[str, Column]) -> Column:
    """How many content signals reach the level of agreement."""
    total = F.lit(0)
    for name in CONTENT:
        if name in components:
            total = total + F.when(components[name] >= AGREES, 1).otherwise(0)
    return total


def abstained(components: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in components.items()]))
