"""Results with in-band warnings, and typed errors."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

#: Impacts from best to worst.
IMPACTS = ("sound", "degraded", "unreliable")


class CairnError(Exception):
    """An error with a code and a context; every subclass has a code of its own."""

    code = "error"

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context

    def as_dict(self) -> dict:
        return {"error": self.code, "message": str(self), "context": self.context}


class TargetError(CairnError):
    code = "target_error"


class FormatError(CairnError):
    code = "format_error"


class UnsupportedError(CairnError):
    code = "unsupported"


class AddressError(CairnError):
    code = "address_error"


class PolicyError(CairnError):
    code = "policy_error"


class CacheError(CairnError):
    code = "cache_error"


@dataclass
class Envelope:
    """A result (rows as dictionaries, or any JSON value) and its warnings."""

    result: object = None
    warnings: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def warn(self, code: str, detail: str, impact: str = "degraded") -> Envelope:
        if impact not in IMPACTS:
            raise ValueError(f"no such impact: {impact}")
        self.warnings.append({"code": code, "impact": impact, "detail": detail})
        return self

    @property
    def reliability(self) -> str:
        """The worst impact of the warnings."""
        return max((w["impact"] for w in self.warnings), key=IMPACTS.index, default="sound")

    def to_json(self, most: int = 120_000) -> str:
        """JSON of at most ``most`` characters: a longer result is cut to whole leading rows, with a warning."""

        def dump(result, warnings):
            worst = max((w["impact"] for w in warnings), key=IMPACTS.index, default="sound")
            return json.dumps({"result": result, "warnings": warnings, "reliability": worst, **self.extra}, default=str)

        text = dump(self.result, self.warnings)
        if len(text) <= most:
            return text
        rows = self.result if isinstance(self.result, list) else []
        low, high = 0, len(rows)
        while low < high:  # the most rows that fit
            mid = (low + high + 1) // 2
            if len(dump(rows[:mid], self._clipped(mid, len(rows)))) <= most:
                low = mid
            else:
                high = mid - 1
        return dump(rows[:low] if rows else None, self._clipped(low, len(rows)))

    def _clipped(self, kept: int, total: int) -> list:
        return [*self.warnings, {"code": "response_clipped", "impact": "degraded", "detail": f"{kept} of {total} rows"}]


def limited(df, limit: int) -> Envelope:
    """At most ``limit`` rows of a frame on the driver, with a warning and the exact total if there are more."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    out = Envelope(rows[:limit])
    if len(rows) > limit:
        out.warn("result_limited", f"{limit} of {df.count()} rows")
    return out


def guarded(fn):
    """Turn every failure of ``fn`` into a structured answer, so that a service stays alive."""

    @functools.wraps(fn)
    def call(*args, **kwargs):
        try:
            return fn(*args, **kwargs)
        except CairnError as e:
            return e.as_dict()
        except (KeyboardInterrupt, SystemExit):
            return {"error": "aborted", "message": "the call was stopped", "context": {}}
        except MemoryError:
            return {"error": "out_of_memory", "message": "the call ran out of memory", "context": {}}
        except Exception as e:  # noqa: BLE001  (anything else is reported, not raised)
            return {"error": "internal_error", "message": f"{type(e).__name__}: {e}", "context": {}}

    return call
