"""The table of registered queries."""

from __future__ import annotations

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under ``name``, with its DuckDB SQL."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep
