"""Queries of the binary readers: every row of a table is wrapped into a file of its own (survey ids SRC, STR, DEC)."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.jvm import methods
from cairn.plans.registry import query
from cairn.session import table
from cairn.sources import tables

ELF_BASE, ELF_OFFSET = 0x401000, 0x78


def little(value: Column, size: int) -> Column:
    """A number's bytes, least significant first."""
    text = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))]))


def literal(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def elf_file(body: Column) -> Column:
    """A 64-bit ELF with one readable and executable segment that holds ``body``."""
    size = F.octet_length(body)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, ELF_BASE + ELF_OFFSET, 64, 0, 0, 64, 56, 1, 64, 0, 0)
    segment = struct.pack("<IIQQQ", 1, 5, ELF_OFFSET, ELF_BASE, ELF_BASE)
    return F.concat(literal(head), literal(segment), little(size, 8), little(size + 32, 8), literal(struct.pack("<Q", 0x1000)), body)


def as_files(spark, sf_dir, name: str, key: str, body: Column):
    return table(spark, sf_dir, name).select(F.col(key).cast("string").alias("sha256"), body.alias("content"))


@query(
    "elf_segments",
    """
    WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS id, 'load0' AS name, CAST(4198400 AS BIGINT) AS va, n + 32 AS vsize, n AS filesize, CAST(120 AS BIGINT) AS fileoff, false AS w, true AS x FROM d WHERE n > 0
    """,
)
def elf_segments(spark, sf_dir):
    """SRC-05, ADR: every document as the code of an ELF file without section headers."""
    found = as_files(spark, sf_dir, "documents", "doc_id", elf_file(F.col("text").cast("binary"))).where(F.octet_length("content") > 120)
    return tables.sections(found).select(F.col("sha256").alias("id"), "name", F.col("va").cast("long").alias("va"), "vsize", "filesize", "fileoff", "w", "x")


@query(
    "text_runs_with_offsets",
    """
    WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS p, o_orderkey % 7 AS z FROM orders)
    SELECT id, z + 2 AS file_offset, p AS run FROM o WHERE length(p) >= 5
    """,
)
def text_runs_with_offsets(spark, sf_dir):
    """STR-01, TOP-05: printable runs and their places, behind some bytes that are not printable."""
    pad = F.unhex(F.repeat(F.lit("00"), (F.col("o_orderkey") % 7 + 2).cast("int")))
    found = as_files(spark, sf_dir, "orders", "o_orderkey", F.concat(pad, F.encode("o_orderpriority", "UTF-8"), literal(b"\0\xff")))
    return tables.strings(found).where("encoding = 'ascii'").select(F.col("sha256").alias("id"), F.col("offset").alias("file_offset"), F.col("text").alias("run"))


@query(
    "byte_needles",
    """
    WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 5 AS INTEGER) AS n FROM orders)
    SELECT id, CAST(i AS BIGINT) AS file_offset FROM (SELECT id, unnest(range(0, n)) AS i FROM o)
    """,
)
def byte_needles(spark, sf_dir):
    """STR-02, STR-04: all places of a needle, overlapping ones too."""
    n = (F.col("o_orderkey") % 5 + 1).cast("int")
    found = as_files(spark, sf_dir, "orders", "o_orderkey", F.encode(F.concat(F.repeat(F.lit("a"), n), F.lit("b")), "UTF-8"))
    return tables.needles(found, {"aa": b"aa"}).select(F.col("sha256").alias("id"), F.col("offset").alias("file_offset"))


CALL = 0xE8


@query(
    "x86_code_index",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k FROM customer)
    SELECT id, 'call' AS kind, CAST(4096 AS BIGINT) AS site, CAST(4096 + 5 + k AS BIGINT) AS target FROM c
    UNION ALL SELECT id, 'immediate', 4101, k * 65537 + 131072 FROM c
    UNION ALL SELECT id, 'jump', 4106, 4096 FROM c
    """,
)
def x86_code_index(spark, sf_dir):
    """DEC-01..05: call, mov with an immediate, short jump back and return, per customer.

    Numbers beyond 32 bits (or that 32 bits would make small negative ones) need a
    64-bit image and a mov of ten bytes; the jump stays five bytes behind it, in a
    segment of its own that lies over its end.
    """
    k = F.col("c_custkey")
    value, most = k * 65537 + 131072, (1 << 32) - (1 << 16)
    call, back = F.concat(literal(bytes([CALL])), little(k, 4)), bytes([0xEB, 0xF4, 0xC3])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("sha256"))
    plain = rows.where(value < most).select("sha256", F.concat(call, literal(b"\xb8"), little(value, 4), literal(back)).alias("content"))
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0x1000, 64, 0, 0, 64, 56, 2, 64, 0, 0)
    for va, place, size in ((0x1000, 0xB0, 15), (0x100A, 0xBF, len(back))):
        head += struct.pack("<IIQQQQQQ", 1, 5, place, va, va, size, size, 1)
    wide = rows.where(value >= most).select("sha256", F.concat(literal(head), call, literal(b"\x48\xb8"), little(value, 8), literal(back)).alias("content"))
    got = tables.code_index(plain, arch="x86", bits=32, base=0x1000).unionByName(tables.code_index(wide))
    return got.select(F.col("sha256").alias("id"), "kind", F.col("site").cast("long").alias("site"), F.col("target").cast("long").alias("target"))


def class_file(method_code: Column, name: Column) -> Column:
    """A class ``demo.N`` whose static method ``run()I`` has the given code."""

    def utf8(text: Column) -> Column:
        data = F.encode(text, "UTF-8")
        size = F.lpad(F.hex(F.octet_length(data).cast("long")), 4, "0")
        return F.concat(literal(b"\x01"), F.unhex(size), data)

    def big(value: Column, size: int) -> Column:
        return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))

    pool = F.concat(
        utf8(name), literal(b"\x07\x00\x01"), utf8(F.lit("java/lang/Object")), literal(b"\x07\x00\x03"), utf8(F.lit("run")), utf8(F.lit("()I")), utf8(F.lit("Code"))
    )
    n = F.octet_length(method_code)
    code = F.concat(literal(b"\x00\x04\x00\x04"), big(n, 4), method_code, literal(b"\x00\x00\x00\x00"))
    body = F.concat(literal(b"\x00\x09\x00\x05\x00\x06\x00\x01\x00\x07"), big(n + 12, 4), code)
    return F.concat(literal(b"\xca\xfe\xba\xbe\x00\x00\x00\x34\x00\x08"), pool, literal(b"\x00\x21\x00\x02\x00\x04\x00\x00\x00\x00\x00\x01"), body, literal(b"\x00\x00"))


def part_classes(spark, sf_dir):
    """``sipush size; istore_0; iload_0; bipush 25; if_icmpge +7; iinc 0 1; goto back; iload_0; ireturn`` for every part."""
    size = F.unhex(F.lpad(F.hex(F.col("p_size").cast("long")), 4, "0"))
    code = F.concat(literal(b"\x11"), size, literal(bytes.fromhex("3b 1a 10 19 a2 00 09 84 00 01 a7 ff f7 1a ac".replace(" ", ""))))
    return as_files(spark, sf_dir, "part", "p_partkey", class_file(code, F.concat(F.lit("demo/P"), F.col("p_partkey").cast("string"))))


@query(
    "class_inventory",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, 'demo.P' || p_partkey AS name, 'java.lang.Object' AS parent, '8' AS java FROM part",
)
def class_inventory(spark, sf_dir):
    """SRC-08, SRC-12: a class file for every part."""
    return tables.classes(part_classes(spark, sf_dir)).select(F.col("sha256").alias("id"), "name", "parent", "java")


@query(
    "jvm_control_flow",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, 'run' AS method, 4 AS blocks, 4 AS edges, 2 AS complexity, 1 AS loops, 1 AS exits FROM part",
)
def jvm_control_flow(spark, sf_dir):
    """DEC-07, DEC-10, GRF-08, AGG-15: blocks, edges and loops of every part's method."""
    return methods.control_flow(part_classes(spark, sf_dir)).select(F.col("sha256").alias("id"), "method", "blocks", "edges", "complexity", "loops", "exits")


@query(
    "jvm_decompile",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS id, true AS structured,
           'public static int run() {' || chr(10) || '  int v0 = ' || p_size || ';' || chr(10) || '  while (v0 < 25) {' || chr(10) || '    v0++;' || chr(10) || '  }' || chr(10) || '  return v0;' || chr(10) || '}' AS source
    FROM part
    """,
)
def jvm_decompile(spark, sf_dir):
    """DCM-01..12: the loop of every part's method as text."""
    return methods.decompiled(part_classes(spark, sf_dir)).select(F.col("sha256").alias("id"), "structured", F.col("text").alias("source"))


@query(
    "heap_strings",
    r"""
    WITH w AS (SELECT CAST(c_custkey AS VARCHAR) AS id, unnest([c_name, c_mktsegment]) AS s FROM customer)
    SELECT id, s AS identifier FROM w
    """,
)
def heap_strings(spark, sf_dir):
    """SRC-16: NUL-separated identifiers of a heap."""
    from cairn.sources import managed

    heap = F.concat(literal(b"\0"), F.encode("c_name", "UTF-8"), literal(b"\0"), F.encode("c_mktsegment", "UTF-8"), literal(b"\0"))
    found = as_files(spark, sf_dir, "customer", "c_custkey", heap)
    rows = tables._table(found, lambda sha, data: ((sha, x) for x in managed.identifier_heap(data)), "sha256 string, identifier string")
    return rows.withColumnRenamed("sha256", "id")
