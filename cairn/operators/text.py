"""Text and byte operators: printable runs, n-grams, entropy, pattern filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latin1(content: Column) -> Column:
    """Bytes as text, one character per byte."""
    return F.decode(content, "ISO-8859-1")


def printable_runs(text: Column, least: int = 5, members: str = r"\x09\x20-\x7e") -> Column:
    """Maximal runs of at least ``least`` member characters."""
    return F.regexp_extract_all(text, F.lit(f"[{members}]{{{least},}}"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def once(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` items; shorter arrays have none."""

    def runs(w):
        joined = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), sep))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    return once(items, runs)


def short_hash(text: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def distinct_sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def character_entropy(df: DataFrame, key: str, text: str, out: str = "entropy", digits: int = 6) -> DataFrame:
    """Bits per character of every text; null for an empty or null one.

    Counting inside a row takes an Arrow function: built-in expressions would
    either fold over single characters or shuffle them.
    """

    @F.arrow_udf(T.DoubleType())
    def bits(texts: pa.Array) -> pa.Array:
        found = []
        for t in texts:
            points = np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            p = np.unique(points, return_counts=True)[1] / max(1, len(points))
            found.append(float(-(p * np.log2(p)).sum()) + 0.0 if len(points) else None)
        return pa.array(found, pa.float64())

    return df.select(key, F.round(bits(F.col(text)), digits).alias(out))


def valid_pattern(pattern: str) -> bool:
    """Whether the engine that will run it takes the pattern."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  (the engine says no)
        return False
    return True


def matching(df: DataFrame, column: str, pattern: str) -> tuple[DataFrame, list[dict]]:
    """Rows whose column matches, ignoring case; an invalid pattern filters nothing and warns."""
    if not valid_pattern(pattern):
        return df, [{"code": "bad_pattern", "impact": "degraded", "detail": f"pattern {pattern!r} is invalid and was ignored"}]
    return df.where(F.col(column).rlike(f"(?i){pattern}")), []


def containing(df: DataFrame, columns: list[str], part: str) -> DataFrame:
    """Rows where one of the columns contains the part, ignoring case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.col(c)), F.lit(part.lower()))
    return df.where(found)


def sniff(head: Column) -> Column:
    """The format of a file from its first bytes (4 KiB are enough), else ``unknown``."""
    h = F.hex(F.substring(head, 1, 4))  # the values below are the formats' fixed first bytes, in order

    def le32(at):
        # four bytes from a position, least significant first
        return F.conv(F.concat(*[F.hex(F.substring(head, at + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("long")

    pe_at = le32(61)
    major = F.conv(F.hex(F.substring(head, 7, 2)), 16, 10).cast("int")
    fat_or_class = F.when(major >= 45, "java_class").otherwise("macho_fat")
    return (
        F.when(F.octet_length(head) < 4, "unknown")
        .when(F.startswith(h, F.lit("4D5A")), F.when(F.hex(F.substring(head, pe_at.cast("int") + 1, 4)) == "50450000", "pe").otherwise("dos_mz"))
        .when(h == "7F454C46", "elf")
        .when(h.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"), "macho")
        .when(h == "CAFEBABE", fat_or_class)
        .when(h.isin("BEBAFECA", "CAFEBABF"), "macho_fat")
        .when(F.hex(F.substring(head, 1, 8)) == "213C617263683E0A", "ar")
        .when(h.isin("504B0304", "504B0506", "504B0708"), "zip")
        .when(F.startswith(h, F.lit("1F8B")), "gzip")
        .otherwise("unknown")
    )

