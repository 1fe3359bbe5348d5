"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.storage import cut, release, shared_dir, shared_path  # noqa: F401  (used by the operators)


def raw_text(text_col: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def values(column: pa.Array, at_once: int = 256):
    """The column's values as Python objects, a few at a time: a batch is never held twice."""
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


def parts_of(batches, at_once: int = 512):
    """Record batches of at most ``at_once`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield batch.slice(at, at_once)


#: What empties the memory that operators keep in a worker between tasks.
CACHES = []


def tidy(caches: bool = True) -> None:
    """Give memory that a batch has left free back to the system, and what other operators have kept in this worker."""
    for clear in CACHES if caches else ():
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


#: A key is hot from this share of the rows on, so that at most as many keys are.
HOT_SHARE = 4096


def spread_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each key; rows without one are left out).

    Keys with more than one row in ``HOT_SHARE`` are joined by broadcast (there are
    fewer than ``HOT_SHARE`` of them), all others by a shuffle.
    """
    least = rows.count() // HOT_SHARE
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(1, least)).select(key).limit(HOT_SHARE)
    few = cut(table.join(F.broadcast(hot), key, "left_semi"), "hot")
    names = [*rows.columns, *(c for c in table.columns if c != key)]
    by_broadcast = rows.join(F.broadcast(few), key).select(*names)
    by_shuffle = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table, key).select(*names)
    return by_broadcast.unionByName(by_shuffle)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of the texts; one number, for sizing partitions."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0]
    return int(total or 0)


def struct_array(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def held_out_expr(id_col: str, mod: int, remainder: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % mod) == remainder
