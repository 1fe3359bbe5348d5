"""The address model: three spaces (file offset, relative, virtual) tied together by sections.

Addresses are DECIMAL(20,0), so that all of u64 fits; text forms are made at the edge.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.asof import asof_join

ADDRESS = "decimal(20,0)"


def hex_text(value: Column) -> Column:
    """``0x`` and lower-case digits without padding."""
    return F.concat(F.lit("0x"), F.lower(F.conv(value.cast(ADDRESS).cast("string"), 10, 16)))


def parse_address(text: Column) -> Column:
    """An address literal: ``0x``, ``0o``, ``0b``, a bare token with a-f as hex, else decimal; null if none of them."""
    t = F.replace(F.lower(F.trim(text)), F.lit("_"), F.lit(""))
    sign = F.when(F.startswith(t, F.lit("-")), -1).otherwise(1)
    body = F.regexp_replace(t, "^[-+]", "")

    def digits(pattern, base):
        return F.when(body.rlike(pattern), F.conv(F.regexp_replace(body, "^0[xob]", ""), base, 10).cast(ADDRESS))

    bare_hex = F.when(body.rlike("^(?=.*[a-f])[0-9a-f]+$"), F.conv(body, 16, 10).cast(ADDRESS))
    plain = F.when(body.rlike("^[0-9]+$"), body.cast(ADDRESS))
    found = F.coalesce(digits("^0x[0-9a-f]+$", 16), digits("^0b[01]+$", 2), digits("^0o[0-7]+$", 8), plain, bare_hex)
    return (sign * found).cast(ADDRESS)


def address_literal(text: str) -> int | None:
    """The same literals for one value of the driver; None if it is none."""
    t = text.strip().lower().replace("_", "")
    sign, body = (-1, t[1:]) if t[:1] == "-" else (1, t.removeprefix("+"))
    for pattern, base in (("0x[0-9a-f]+", 16), ("0b[01]+", 2), ("0o[0-7]+", 8), ("[0-9]+", 10), ("[0-9a-f]+", 16)):
        if re.fullmatch(pattern, body):
            return sign * int(body, base)
    return None


def permissions(r: Column, w: Column, x: Column) -> Column:
    """``rwx`` with ``-`` for what is missing."""
    return F.concat(*[F.when(c, letter).otherwise("-") for c, letter in ((r, "r"), (w, "w"), (x, "x"))])


def pointers(content: Column, offset: Column, bits: int, endian: str = "little") -> Column:
    """The number stored at a byte offset, as wide as a pointer; null beyond the end."""
    size = bits // 8
    raw = F.substring(content, offset.cast("int") + 1, F.lit(size))
    text = F.hex(raw)
    if endian == "little":
        text = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when((offset >= 0) & (F.octet_length(raw) == size), F.conv(text, 16, 10).cast(ADDRESS))


def read_at(points: DataFrame, images: DataFrame, sections: DataFrame, by: list[str], length: int, va: str = "va", out: str = "bytes", width: float | None = None) -> DataFrame:
    """``points`` with up to ``length`` bytes at their addresses, clipped to the section's file bytes; null if there are none.

    ``images`` has ``by`` and ``content``.
    """
    spans = sections.withColumn("va_end", F.col("va") + F.greatest("vsize", "filesize")).withColumn("__start", F.col("va"))
    got = locate(points, spans.withColumnRenamed("va", "__va"), by, va, "__va", "va_end", ["__start", "fileoff", "filesize"], width=width)
    delta = F.col(va) - F.col("__start")
    got = got.withColumns({"__at": (F.col("fileoff") + delta).cast("int"), "__n": F.least(F.lit(length), F.col("filesize") - delta).cast("int")})
    read = F.when(F.col("__n") > 0, F.substring(F.col("content"), F.col("__at") + 1, F.col("__n")))
    return got.join(images.select(*by, "content"), by, "left").withColumn(out, read).drop("content", "__start", "fileoff", "filesize", "__at", "__n")


def unmapped(points: DataFrame, sections: DataFrame, by: list[str], va: str = "va", width: float | None = None) -> DataFrame:
    """The points that no section holds, each with its image's section table as text (what an address error shows)."""
    spans = sections.withColumn("va_end", F.col("va") + F.greatest("vsize", "filesize")).withColumn("__start", F.col("va"))
    got = locate(points, spans.withColumnRenamed("va", "__va"), by, va, "__va", "va_end", ["__start"], width=width)
    line = F.concat_ws(" ", F.col("name"), hex_text(F.col("va")), hex_text(F.col("va") + F.greatest("vsize", "filesize")))
    listed = sections.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("sections"))
    return got.where(F.col("__start").isNull()).drop("__start").join(listed, by, "left")


def locate(points: DataFrame, sections: DataFrame, by: list[str], point: str, start: str, end: str, take: list[str], ordinal: str | None = None, width: float | None = None) -> DataFrame:
    """``points`` with ``take`` of the section they are in, null if in none.

    The section with the nearest start at or before the point is asked alone:
    if it ends before the point, an earlier, longer section does not count.
    Of equal starts the last (greatest ``ordinal``) counts; empty sections never do.
    """
    first = [ordinal] if ordinal else []
    asked = sections.where(F.col(end) > F.col(start)).select(*by, F.col(start).alias(point), *first, F.col(end).alias("__end"), *[c for c in take if c not in first])
    got = asof_join(points, asked, by, point, [*first, "__end", *[c for c in take if c not in first]], width)
    inside = F.col(point) < F.col("__end")
    others = [c for c in points.columns]
    return got.select(*others, *[F.when(inside, F.col(c)).alias(c) for c in take])


def offset_to_va(points: DataFrame, sections: DataFrame, by: list[str], offset: str = "offset", out: str = "va", width: float | None = None) -> DataFrame:
    """The virtual address of a file offset, null if no section's file bytes hold it."""
    files = sections.withColumn("file_end", F.col("fileoff") + F.col("filesize")).withColumnRenamed("va", "__va")
    got = locate(points, files, by, offset, "fileoff", "file_end", ["__va", "fileoff"], width=width)
    return got.withColumn(out, (F.col("__va") + F.col(offset) - F.col("fileoff")).cast(ADDRESS)).drop("__va", "fileoff")


def va_to_offset(points: DataFrame, sections: DataFrame, by: list[str], va: str = "va", out: str = "offset", width: float | None = None) -> DataFrame:
    """The file offset of a virtual address, null if unmapped or in a section's virtual tail."""
    spans = sections.withColumn("va_end", F.col("va") + F.greatest("vsize", "filesize")).withColumn("__start", F.col("va"))
    got = locate(points, spans.withColumnRenamed("va", "__va"), by, va, "__va", "va_end", ["__start", "fileoff", "filesize"], width=width)
    delta = F.col(va) - F.col("__start")
    return got.withColumn(out, F.when(delta < F.col("filesize"), F.col("fileoff") + delta).cast("long")).drop("__start", "fileoff", "filesize")


def translate(points: DataFrame, sections: DataFrame, images: DataFrame, by: list[str], address: str = "address", width: float | None = None) -> DataFrame:
    """Up to three readings of each address (as virtual, relative, file offset) with section and file bytes.

    Adds ``space, va, rva, offset, section, mapped, has_file_bytes`` and, where the sections say, ``perms``.
    """
    told = {"r", "w", "x"} <= set(sections.columns)
    based = points.join(images.select(*by, "image_base"), by)
    raw = F.col(address).cast(ADDRESS)
    as_va = based.select("*", F.lit("va").alias("space"), raw.alias("va"))
    as_rva = based.select("*", F.lit("rva").alias("space"), (raw + F.col("image_base")).cast(ADDRESS).alias("va"))
    as_file = offset_to_va(based.withColumn("__off", raw), sections, by, "__off", width=width).select(*based.columns, F.lit("file").alias("space"), "va")
    spans = sections.withColumn("va_end", F.col("va") + F.greatest("vsize", "filesize")).select(*by, F.col("va").alias("__start"), "va_end", F.col("name").alias("section"), *([permissions(F.col("r"), F.col("w"), F.col("x")).alias("perms")] if told else []))
    every = as_va.unionByName(as_rva).unionByName(as_file)
    named = locate(every, spans, by, "va", "__start", "va_end", ["section", *(["perms"] if told else [])], width=width)
    got = va_to_offset(named, sections, by, width=width)
    return got.withColumns(
        {"rva": (F.col("va") - F.col("image_base")).cast(ADDRESS), "mapped": F.col("section").isNotNull(), "has_file_bytes": F.col("offset").isNotNull()}
    ).drop("image_base")
