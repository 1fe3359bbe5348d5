"""All registered queries of the engine's operators."""

from __future__ import annotations

from cairn.plans import addressing, binaries, graphs, knowledge, linking, matches, readers, stores, streams, texts  # noqa: F401  (they register their queries)
from cairn.plans.registry import ORACLE, QUERIES  # noqa: F401
