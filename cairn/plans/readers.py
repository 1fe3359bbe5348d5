"""Queries of the readers over whole files: PE, ELF, Mach-O, archives, assemblies, methods, native code (survey ids SRC, STR, DEC, DCM, FPR, ALG, XRF)."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from cairn.jvm import methods
from cairn.operators import addresses, catalog, grouping, xrefs
from cairn.plans import forge
from cairn.plans.registry import query
from cairn.session import table
from cairn.sources import algorithms, tables


def key():
    return F.col("sha256").alias("id")



def made(spark, sf_dir, maker, name="part", key="p_partkey"):
    return forge.files(table(spark, sf_dir, name).select(key), key, maker)


def whole(column: str):
    return F.col(column).cast("long").alias(column)


# ---- containers


@query(
    "pe_images",
    f"SELECT CAST(p_partkey AS VARCHAR) AS id, 'pe' AS format, 'x86' AS arch, 64 AS bits, CAST({forge.PE_BASE} AS BIGINT) AS image_base, CAST({forge.PE_BASE + 0x1000} AS BIGINT) AS entry_va, p_partkey % 2 = 1 AS is_library FROM part",
)
def pe_images(spark, sf_dir):
    """SRC-04, SRC-03: headers of 64-bit images."""
    return tables.images(made(spark, sf_dir, forge.pe)).select(key(), "format", "arch", "bits", whole("image_base"), whole("entry_va"), "is_library")


@query(
    "pe_imports_and_exports",
    f"""
    SELECT CAST(p_partkey AS VARCHAR) AS id, 'import' AS kind, 'k' || (p_partkey % 3) || '!Fn' || (p_partkey % 5) AS name, CAST({forge.PE_BASE + 0x2060} AS BIGINT) AS va FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'import', 'k' || (p_partkey % 3) || '!ord#' || (p_partkey % 100 + 1), {forge.PE_BASE + 0x2068} FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'export', 'Exp' || (p_partkey % 4), {forge.PE_BASE + 0x1000} FROM part
    """,
)
def pe_imports_and_exports(spark, sf_dir):
    """SRC-04, STR-06: imports by name and number with qualified names; exports without forwarders."""
    found = made(spark, sf_dir, forge.pe)
    imports = tables.imports(found).select(key(), F.lit("import").alias("kind"), F.col("qualified").alias("name"), F.col("slot").cast("long").alias("va"))
    return imports.unionByName(tables.symbols(found).select(key(), F.col("kind"), "name", whole("va")))


@query(
    "elf_sections",
    """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, p_partkey % 2 = 0 AS wide FROM part)
    SELECT id, '.text' AS name, CAST(65536 + 512 AS BIGINT) AS va, CAST(4 AS BIGINT) AS vsize, CAST(4 AS BIGINT) AS filesize, 'r-x' AS perms FROM p
    UNION ALL SELECT id, '.bss', 65536 + 32768, 256 + k % 16, 0, 'rw-' FROM p
    UNION ALL SELECT id, '.dynsym', CASE WHEN wide THEN 65536 + 640 ELSE 65536 + 608 END, CASE WHEN wide THEN 72 ELSE 48 END, CASE WHEN wide THEN 72 ELSE 48 END, 'r--' FROM p
    UNION ALL SELECT id, '.dynamic', CASE WHEN wide THEN 65536 + 720 ELSE 65536 + 656 END, CASE WHEN wide THEN 32 ELSE 16 END, CASE WHEN wide THEN 32 ELSE 16 END, 'rw-' FROM p
    """,
)
def elf_sections(spark, sf_dir):
    """SRC-05, STR-15: the sections that occupy memory, of both widths and byte orders."""
    return tables.sections(made(spark, sf_dir, forge.elf)).select(key(), "name", whole("va"), "vsize", "filesize", addresses.permissions(F.col("r"), F.col("w"), F.col("x")).alias("perms"))


@query(
    "elf_symbols",
    """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k FROM part)
    SELECT id, 'main' AS name, CAST(66048 AS BIGINT) AS va, CAST(4 AS BIGINT) AS size, 'func' AS kind, 'symtab' AS source FROM p
    UNION ALL SELECT id, 'fn' || (k % 7), 66050, k % 9, 'object', 'symtab' FROM p
    UNION ALL SELECT id, 'fn' || (k % 7), 66050, 2, 'func', 'dynsym' FROM p
    UNION ALL SELECT id, 'fn' || (k % 7), 66050, 2, 'export', 'export' FROM p
    UNION ALL SELECT id, 'imp' || (k % 5), NULL, NULL, 'import', 'dynsym' FROM p
    """,
)
def elf_symbols(spark, sf_dir):
    """SRC-05: symbols, dynamic symbols, exports, and undefined ones as imports without a slot."""
    found = made(spark, sf_dir, forge.elf)
    none = F.lit(None).cast("long")
    imports = tables.imports(found).select(key(), F.col("qualified").alias("name"), F.col("slot").cast("long").alias("va"), none.alias("size"), F.lit("import").alias("kind"), F.lit("dynsym").alias("source"))
    return tables.symbols(found).select(key(), "name", whole("va"), "size", "kind", "source").unionByName(imports)


@query(
    "elf_images",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'x86' ELSE 'ppc' END AS arch, CASE WHEN p_partkey % 2 = 0 THEN 64 ELSE 32 END AS bits, CASE WHEN p_partkey % 2 = 0 THEN 'little' ELSE 'big' END AS endian, CAST(65536 AS BIGINT) AS image_base, 'lib' || (p_partkey % 3) || '.so.6' AS needed FROM part",
)
def elf_images(spark, sf_dir):
    """SRC-05: machine, base (the least segment) and needed libraries."""
    return tables.images(made(spark, sf_dir, forge.elf)).select(key(), "arch", "bits", "endian", whole("image_base"), F.array_join("needed", ",").alias("needed"))


@query(
    "macho_images",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS id, 'aarch64' AS arch, 64 AS bits, CAST(4294967296 AS BIGINT) AS image_base, CAST(4294969344 AS BIGINT) AS entry_va, p_partkey % 2 = 1 AS is_library,
           '/usr/lib/lib' || (p_partkey % 4) || '.dylib' AS needed, '__TEXT,__text' AS section, '_main' AS symbol, '_ext' || (p_partkey % 6) AS imported FROM part
    """,
)
def macho_images(spark, sf_dir):
    """SRC-06, SRC-26: cpu, base without the zero page, entry, libraries, sections, symbols."""
    found = made(spark, sf_dir, forge.macho)
    got = tables.images(found).select(key(), "arch", "bits", whole("image_base"), whole("entry_va"), "is_library", F.array_join("needed", ",").alias("needed"))
    got = got.join(tables.sections(found).select(key(), F.col("name").alias("section")), "id")
    got = got.join(tables.symbols(found).where("source = 'symtab'").select(key(), F.col("name").alias("symbol")), "id")
    return got.join(tables.imports(found).select(key(), F.col("name").alias("imported")), "id")


# ---- managed code


@query(
    "jar_inventory",
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey % 3 + 2 AS INTEGER) AS classes, CAST(1 AS INTEGER) AS resources, 'demo.M' || (s_suppkey % 4) AS main, CAST(s_suppkey % 3 + 1 AS INTEGER) AS in_demo, CAST(1 AS INTEGER) AS in_other,
           CASE WHEN s_suppkey % 2 = 0 THEN 'demo/Bad.class' ELSE '' END AS unparsed FROM supplier
    """,
)
def jar_inventory(spark, sf_dir):
    """SRC-09, SRC-10, MAP-01: classes, resources, manifest (the last value counts), packages and damaged entries."""
    got = tables.jars(made(spark, sf_dir, forge.jar, "supplier", "s_suppkey"))
    return got.select(key(), "classes", "resources", F.element_at("manifest", "Main-Class").alias("main"), F.element_at("packages", "demo").alias("in_demo"), F.element_at("packages", "other").alias("in_other"), F.array_join(F.transform("unparsed", lambda u: u["entry"]), ",").alias("unparsed"))


@query(
    "jar_classes",
    """
    WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS k, 45 + s_suppkey % 20 AS major, unnest(range(0, s_suppkey % 3 + 1)) AS i FROM supplier)
    SELECT id, 'demo/C' || i || '.class' AS entry, 'demo.C' || i AS name, CASE WHEN major <= 48 THEN '1.' || (major - 44) ELSE CAST(major - 44 AS VARCHAR) END AS java FROM s
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'other/D.class', 'other.D', '8' FROM supplier
    """,
)
def jar_classes(spark, sf_dir):
    """SRC-13, SRC-11, SRC-25: the classes of archives, damaged ones left out, with their Java versions."""
    return tables.classes(made(spark, sf_dir, forge.jar, "supplier", "s_suppkey")).select(key(), "entry", "name", "java")


@query(
    "cli_inventory",
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS id, '2.5' AS runtime, 'v4.0.30319' AS version, 'Type' || (s_suppkey % 6) || ',Main' AS identifiers, 'hello ' || (s_suppkey % 8) AS user_strings,
           '#Strings,#US,#~' AS streams, CAST(1 AS BIGINT) AS modules, CAST(s_suppkey % 5 + 1 AS BIGINT) AS types, CAST(3 AS BIGINT) AS methods FROM supplier
    """,
)
def cli_inventory(spark, sf_dir):
    """SRC-15, SRC-16, SRC-17, SRC-18, SRC-19, MAP-01: metadata root, both heaps and row counts of assemblies."""
    got = tables.assemblies(made(spark, sf_dir, forge.assembly, "supplier", "s_suppkey"))
    rows = lambda name: F.element_at("table_rows", name)
    return got.select(key(), "runtime", "version", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("user_strings", ",").alias("user_strings"), F.array_join(F.array_sort(F.map_keys("streams")), ",").alias("streams"), rows("Module").alias("modules"), rows("TypeDef").alias("types"), rows("MethodDef").alias("methods"))


def member_class(k: int) -> bytes:
    fields = [(0x1A, f"K{k % 4}", "J")] + [(0x2, f"f{i}", "[I") for i in range(k % 3)]
    return forge.class_file(f"demo/P{k}", [(0x1, "<init>", "()V", b"\xb1", (), (), ()), (0x401, f"todo{k % 5}", "(IJ)V", None, (), (), ())], fields, parent=f"demo/Base{k % 2}", interfaces=("demo/Face", "java/lang/Runnable")[: k % 3], access=0x421)


@query(
    "class_members",
    """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k FROM part)
    SELECT id, 'field' AS kind, 'K' || (k % 4) AS name, 'J' AS descriptor, 'private,static,final' AS access, false AS is_abstract, true AS is_static, false AS has_code FROM p
    UNION ALL SELECT id, 'field', 'f' || i, '[I', 'private', false, false, false FROM (SELECT id, unnest(range(0, k % 3)) AS i FROM p)
    UNION ALL SELECT id, 'method', '<init>', '()V', 'public', false, false, true FROM p
    UNION ALL SELECT id, 'method', 'todo' || (k % 5), '(IJ)V', 'public,abstract', true, false, false FROM p
    """,
)
def class_members(spark, sf_dir):
    """SRC-12, SRC-24, LNK-06: members with their access, and which are abstract, static or have code."""
    return tables.members(made(spark, sf_dir, member_class)).select(key(), "kind", "name", "descriptor", F.array_join("access", ",").alias("access"), "is_abstract", "is_static", "has_code")


@query(
    "class_requirements",
    """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, 'demo.P' || p_partkey AS me FROM part)
    SELECT id, 'class' AS kind, me AS owner, me AS from_class FROM p UNION ALL SELECT id, 'class', 'demo.Base' || (k % 2), me FROM p
    UNION ALL SELECT id, kind, 'demo.Face', me FROM p, (SELECT unnest(['class', 'supertype']) AS kind) WHERE k % 3 > 0
    UNION ALL SELECT id, kind, 'java.lang.Runnable', me FROM p, (SELECT unnest(['class', 'supertype']) AS kind) WHERE k % 3 > 1
    UNION ALL SELECT id, 'supertype', 'demo.Base' || (k % 2), me FROM p
    """,
)
def class_requirements(spark, sf_dir):
    """LNK-02, DEC-09: what classes refer to, supertypes too."""
    return tables.requirements(made(spark, sf_dir, member_class)).select(key(), "kind", "owner", "from_class")


#: Java of the bodies that ``forge`` makes; ~ is a line break, # the constant.
SOURCES = {
    "if": "if (n > #) {~    return n - #;~  }~  return # - n;",
    "ternary": "return n < # ? # : n;",
    "while": "int v1 = 0;~  while (n > #) {~    v1 += n;~    n--;~  }~  return v1;",
    "switch": "switch (n) {~    case #:~      return 1;~    case 500:~      return 2;~    default:~      return 0;~  }",
    "try": "try {~    return Math.abs(n);~  } catch (RuntimeException v1) {~    return #;~  }",
    "concat": 'return ("n#" + n).length();',
    "arithmetic": "return n * # + (n << 3 & #);",
    "call": "return run(n - #);",
}
SOURCE_SQL = "list_element([" + ", ".join("'" + SOURCES[k].replace("'", "''") + "'" for k in forge.KINDS) + "], CAST(p_partkey % 8 AS INTEGER) + 1)"


@query(
    "decompiled_methods",
    f"SELECT CAST(p_partkey AS VARCHAR) AS id, replace(replace('public static int run(int n) {{~  ' || {SOURCE_SQL} || '~}}', '~', chr(10)), '#', CAST(p_partkey // 8 % 100 AS VARCHAR)) AS source, true AS structured FROM part",
)
def decompiled_methods(spark, sf_dir):
    """DCM-01..12, STR-10, STR-12: if, ternary, while, switch, try, string building, precedence and calls, with names of locals."""
    got = methods.decompiled(made(spark, sf_dir, forge.method_class))
    return got.select(key(), F.col("text").alias("source"), "structured")


SHAPES = {"if": (3, 2, 1, 0, 2), "ternary": (4, 4, 2, 0, 1), "while": (4, 4, 2, 1, 1), "switch": (4, 3, 1, 0, 3), "try": (2, 1, 1, 0, 2), "concat": (1, 0, 1, 0, 1), "arithmetic": (1, 0, 1, 0, 1), "call": (1, 0, 1, 0, 1)}


def shape_sql(i: int) -> str:
    return f"CAST(list_element([{', '.join(str(SHAPES[k][i]) for k in forge.KINDS)}], CAST(p_partkey % 8 AS INTEGER) + 1) AS INTEGER)"


@query("method_shapes", f"SELECT CAST(p_partkey AS VARCHAR) AS id, {shape_sql(0)} AS blocks, {shape_sql(1)} AS edges, {shape_sql(2)} AS complexity, {shape_sql(3)} AS loops, {shape_sql(4)} AS exits FROM part")
def method_shapes(spark, sf_dir):
    """DEC-07, DEC-10, GRF-08, AGG-15, AGG-16, FLT-13, TOP-07: blocks (exception edges too) of methods of eight kinds."""
    got = methods.control_flow(made(spark, sf_dir, forge.method_class)).where("method = 'run'")
    return got.select(key(), "blocks", "edges", "complexity", "loops", "exits")


@query(
    "method_lines",
    """
    WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, unnest([0, 1, 3, 4]) AS pc FROM part WHERE p_partkey % 8 = 7)
    SELECT id, CAST(pc AS INTEGER) AS pc, CAST(CASE WHEN pc = 0 THEN 10 ELSE 11 END AS INTEGER) AS line, 'n' AS first_local FROM p
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 7, 11, 'n' FROM part WHERE p_partkey % 8 = 7
    """,
)
def method_lines(spark, sf_dir):
    """WIN-06, STR-13: the line of every instruction, and the name that a slot has there."""
    got = tables.lines(made(spark, sf_dir, forge.method_class)).where("CAST(sha256 AS BIGINT) % 8 = 7")
    return got.select(key(), "pc", "line", F.element_at("locals", 1).alias("first_local"))


@query("pool_constants", "SELECT CAST(p_partkey AS VARCHAR) AS id, '\"n' || (p_partkey // 8 % 100) || '\"' AS text FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'java.lang.Math.abs(I)I' FROM part")
def pool_constants(spark, sf_dir):
    """DEC-08, DEC-09: what constants of a pool stand for."""
    got = tables.constants(made(spark, sf_dir, forge.method_class))
    return got.where("tag = 8 OR (tag = 10 AND text LIKE '%Math%')").select(key(), "text")


# ---- bytes and addresses


@query(
    "hex_dump",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || '|' || c_mktsegment || '|' AS s FROM customer),
         r AS (SELECT id, s, unnest(range(4, least(length(s), 36), 16)) AS o FROM c)
    SELECT id, CAST(o AS BIGINT) AS file_offset, lower(hex(encode(substr(s, CAST(o AS INTEGER) + 1, least(16, 36 - CAST(o AS INTEGER)))))) AS bytes, substr(s, CAST(o AS INTEGER) + 1, least(16, 36 - CAST(o AS INTEGER))) AS text FROM r
    """,
)
def hex_dump(spark, sf_dir):
    """SRC-22, STR-09, MTH-03: rows of sixteen bytes from an offset, at most as many as asked for."""
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sha256"), F.encode(F.concat("c_name", F.lit("|"), "c_mktsegment", F.lit("|")), "UTF-8").alias("content"))
    return tables.dump(found, 4, 32).select(key(), F.col("offset").alias("file_offset"), F.col("hex").alias("bytes"), "text")


@query(
    "read_at_address",
    f"""
    WITH p AS (SELECT p_partkey AS k, unnest(['text', 'tail', 'gap']) AS place FROM part WHERE p_partkey % 10 = 0)
    SELECT CAST(k AS VARCHAR) AS id, place, CASE place WHEN 'text' THEN 'c3cccccc' WHEN 'tail' THEN 'cccc' END AS bytes FROM p
    """,
)
def read_at_address(spark, sf_dir):
    """ADR-07: bytes at an address, clipped to the section's file bytes; none where nothing is mapped."""
    found = made(spark, sf_dir, forge.pe).where("CAST(sha256 AS BIGINT) % 10 = 0")
    places = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(str(forge.PE_BASE + v)).cast(addresses.ADDRESS).alias("va")) for n, v in (("text", 0x1000), ("tail", 0x11FE), ("gap", 0x9000))])
    points = found.select("sha256", F.explode(places).alias("p")).select("sha256", "p.*")
    got = addresses.read_at(points, found, tables.sections(found).select("sha256", "va", "vsize", "fileoff", "filesize"), ["sha256"], 4)
    return got.select(key(), "place", F.lower(F.hex("bytes")).alias("bytes"))


@query(
    "unmapped_addresses",
    "SELECT o_orderkey AS id, '.data 0x140002000 0x140002400; .text 0x140001000 0x140001200' AS sections FROM orders WHERE o_orderkey % 5 >= 3",
)
def unmapped_addresses(spark, sf_dir):
    """ADR-06: addresses that no section holds, with the sections there are."""
    found = forge.files(spark.range(1), "id", forge.pe)
    va = F.element_at(F.array(*[F.lit(str(forge.PE_BASE + v)).cast(addresses.ADDRESS) for v in (0x1000, 0x11FF, 0x23FF, 0x2400, 0x500)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    points = table(spark, sf_dir, "orders").select(F.lit("0").alias("sha256"), "o_orderkey", va.alias("va"))
    got = addresses.unmapped(points, tables.sections(found).select("sha256", "name", "va", "vsize", "fileoff", "filesize"), ["sha256"], width=float(1 << 20))
    return got.select(F.col("o_orderkey").alias("id"), "sections")


@query(
    "stored_pointers",
    """
    SELECT o_orderkey AS id, o_orderkey * 257 AS little, o_orderkey % 65536 AS big FROM orders
    """,
)
def stored_pointers(spark, sf_dir):
    """ADR-12: numbers as wide as a pointer, of both byte orders; none beyond the end."""
    from cairn.plans.binaries import little

    big = F.unhex(F.lpad(F.hex((F.col("o_orderkey") % 65536).cast("long")), 8, "0"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(b"\0"), little(F.col("o_orderkey") * 257, 8), big).alias("content"))
    at = lambda place, bits, order: addresses.pointers(F.col("content"), F.lit(place), bits, order)
    return rows.where(at(6, 64, "little").isNull()).select(F.col("o_orderkey").alias("id"), at(1, 64, "little").cast("long").alias("little"), at(9, 32, "big").cast("long").alias("big"))


@query(
    "translate_with_permissions",
    f"""
    SELECT CAST(p_partkey AS VARCHAR) AS id, 'va' AS space, '.text' AS section, 'r-x' AS perms, CAST(1024 + p_partkey % 512 AS BIGINT) AS file_offset FROM part
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'rva', NULL, NULL, NULL FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'file', NULL, NULL, NULL FROM part
    """,
)
def translate_with_permissions(spark, sf_dir):
    """ADR-08, STR-15: the readings of an address with the permissions of where it lies."""
    found = made(spark, sf_dir, forge.pe)
    points = found.select("sha256", (F.lit(str(forge.PE_BASE + 0x1000)).cast(addresses.ADDRESS) + F.col("sha256").cast("long") % 512).cast(addresses.ADDRESS).alias("address"))
    got = addresses.translate(points, tables.sections(found), tables.images(found), ["sha256"])
    return got.select(key(), "space", "section", "perms", F.col("offset").alias("file_offset"))


def packed_file(k: int) -> bytes:
    from cairn.plans.binaries import ELF_BASE, ELF_OFFSET

    body = (bytes(range(256)) * 16, b"\x55\x90\xc3" * 300, bytes(4096))[k % 3]
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, ELF_BASE + ELF_OFFSET, 64, 0, 0, 64, 56, 1, 64, 0, 0)
    return head + struct.pack("<IIQQQQQQ", 1, 4 if k % 6 == 5 else 5, ELF_OFFSET, ELF_BASE, ELF_BASE, len(body), len(body), 0x1000) + body


@query(
    "image_warnings",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS id, 'packed_exec_section' AS code, 'unreliable' AS impact FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'packed_sections_skipped', 'degraded' FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'no_executable_sections', 'degraded' FROM part WHERE p_partkey % 6 = 5
    """,
)
def image_warnings(spark, sf_dir):
    """EVD-02, EVD-03, FLT-02: packed sections, those an index skips, images without code."""
    return tables.warnings(made(spark, sf_dir, packed_file), indexed=True).select(key(), "code", "impact")


@query(
    "section_kinds",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey % 6 <> 5 AS executable, p_partkey % 3 = 0 AS packed, p_partkey % 3 <> 0 AND p_partkey % 6 <> 5 AS analyzable, p_partkey % 6 = 5 AS holds_data, CASE p_partkey % 3 WHEN 0 THEN 8.0 WHEN 2 THEN 0.0 ELSE 1.584963 END AS entropy FROM part",
)
def section_kinds(spark, sf_dir):
    """FLT-01, AGG-01: executable, packed, analyzable and data sections by the entropy of their bytes."""
    return tables.code_sections(made(spark, sf_dir, packed_file)).select(key(), "executable", "packed", "analyzable", "holds_data", "entropy")


@query(
    "byte_entropy_of_files",
    """
    WITH c AS (SELECT c_custkey AS k, c_name || c_mktsegment AS s FROM customer), b AS (SELECT k, length(s) AS n, unnest(string_split(s, '')) AS ch FROM c),
         g AS (SELECT k, n, count(*) AS m FROM b GROUP BY k, n, ch)
    SELECT CAST(k AS VARCHAR) AS id, round(sum(-(m / n) * log2(m / n)), 4) AS entropy FROM g GROUP BY k
    """,
)
def byte_entropy_of_files(spark, sf_dir):
    """AGG-01: bits a byte of raw files."""
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sha256"), F.encode(F.concat("c_name", "c_mktsegment"), "UTF-8").alias("content"))
    return tables.sections(found, arch="x86", bits=32).select(key(), F.round("entropy", 4).alias("entropy"))


# ---- native code


def code_file(code: bytes, text: bytes = b"") -> bytes:
    """An ELF with code at 0x401000 and, behind it, a data section at 0x500000."""
    from cairn.plans.binaries import ELF_BASE

    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, ELF_BASE, 64, 0, 0, 64, 56, 2, 64, 0, 0)
    first, second = 0xB0, 0xB0 + len(code)
    load = struct.pack("<IIQQQQQQ", 1, 5, first, ELF_BASE, ELF_BASE, len(code), len(code), 1) + struct.pack("<IIQQQQQQ", 1, 6, second, 0x500000, 0x500000, len(text), len(text), 1)
    return (head + load).ljust(first, b"\0") + code + text


def caller(k: int) -> bytes:
    """main calls f (``k % 3 + 1`` times) and jumps by a register; f loads a string's address and a constant, loops and returns."""
    n = k % 3 + 1
    main = b"".join(b"\xe8" + struct.pack("<i", 5 * n + 3 - 5 * (i + 1)) for i in range(n)) + b"\xff\xd0\xc3"
    loop = b"\xb8" + struct.pack("<I", 0x500001) + b"\xb9" + struct.pack("<I", 0x10000 + k) + b"\x48\xff\xc9" + b"\x75\xfb" + b"\xc3"
    return code_file(main + loop, b"\0" + f"text {k % 7} of it".encode() + b"\0" + struct.pack("<Q", 0x401000))


@query(
    "function_starts",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(4198400 AS BIGINT) AS va, 'entry' AS evidence FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 4198400 + 5 * (c_custkey % 3 + 1) + 3, 'call' FROM customer
    """,
)
def function_starts(spark, sf_dir):
    """SET-02: starts by entry and call targets."""
    return tables.functions(made(spark, sf_dir, caller, "customer", "c_custkey")).select(key(), whole("va"), "evidence")


@query("prologue_starts", "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(4096 + c_custkey % 9 + 1 AS BIGINT) AS va, 'prologue' AS evidence FROM customer")
def prologue_starts(spark, sf_dir):
    """SET-02, SRC-07: in raw files where nothing is named, byte patterns that functions begin with."""
    found = made(spark, sf_dir, lambda k: b"\xc3" * (k % 9 + 1) + b"\x55\x48\x8b\xec\xc3", "customer", "c_custkey")
    return tables.functions(found, arch="x86", bits=64, base=0x1000).select(key(), whole("va"), "evidence")


@query(
    "code_references",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_custkey % 3 + 1 AS n FROM customer)
    SELECT id, 'call' AS kind, CAST(4198400 + 5 * i AS BIGINT) AS site, CAST(4198400 + 5 * n + 3 AS BIGINT) AS target, 'call' AS detail FROM (SELECT id, n, unnest(range(0, n)) AS i FROM c)
    UNION ALL SELECT id, 'indirect_call', 4198400 + 5 * n, NULL, 'call' FROM c
    UNION ALL SELECT id, 'reference', 4198400 + 5 * n + 3, 5242881, 'imm:mov' FROM c
    UNION ALL SELECT id, 'immediate', 4198400 + 5 * n + 8, 65536 + k, 'mov' FROM c
    UNION ALL SELECT id, 'jump', 4198400 + 5 * n + 16, 4198400 + 5 * n + 13, 'jne' FROM c
    """,
)
def code_references(spark, sf_dir):
    """DEC-02..05, JON-01, FLT-10: one pass over code: calls, jumps, references to mapped addresses, immediates."""
    return tables.code_index(made(spark, sf_dir, caller, "customer", "c_custkey")).select(key(), "kind", whole("site"), whole("target"), "detail")


@query(
    "native_control_flow",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 3 + 1 AS n FROM customer)
    SELECT id, CAST(4198400 AS BIGINT) AS va, CAST(n + 2 AS INTEGER) AS insns, CAST(1 AS INTEGER) AS blocks, CAST(0 AS INTEGER) AS edges, CAST(1 AS INTEGER) AS complexity, CAST(0 AS INTEGER) AS loops, true AS single_exit,
           array_to_string(list_concat(list_transform(range(0, n), lambda i: printf('0x%x', CAST(4198400 + 5 * n + 3 AS BIGINT))), ['indirect:rax']), ',') AS calls FROM c
    UNION ALL SELECT id, 4198400 + 5 * n + 3, 5, 3, 3, 2, 1, true, '' FROM c
    """,
)
def native_control_flow(spark, sf_dir):
    """GRF-07, AGG-16, TOP-09: blocks, edges, loops, exits and calls of native functions."""
    got = tables.control_flow(made(spark, sf_dir, caller, "customer", "c_custkey"))
    calls = F.array_join(F.flatten(F.transform("blocks", lambda b: b["calls"])), ",")
    return got.select(key(), whole("va"), "insns", F.size("blocks").alias("blocks"), "edges", "complexity", F.size("loops").alias("loops"), "single_exit", calls.alias("calls"))


@query(
    "function_fingerprints",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_custkey % 3 + 1 AS n FROM customer)
    SELECT id, CAST(4198400 AS BIGINT) AS va, CAST(5 * n + 3 AS INTEGER) AS size, CAST(n + 2 AS INTEGER) AS insns, repeat('e8????????', n) || 'ffd0c3' AS signature, '' AS strings, '' AS constants, CAST(n AS INTEGER) AS calls, CAST(1 AS INTEGER) AS indirect_calls, CAST(1 AS INTEGER) AS returns, CAST(0 AS INTEGER) AS branches FROM c
    UNION ALL SELECT id, 4198400 + 5 * n + 3, 16, 5, 'b8????????b9' || lower(substr(printf('%02x', k % 256), 1, 2)) || printf('%02x', k // 256) || '010048ffc975??c3', 'text ' || (k % 7) || ' of it', CAST(65536 + k AS VARCHAR), 0, 0, 1, 1 FROM c
    """,
)
def function_fingerprints(spark, sf_dir):
    """FPR-01, FPR-02, AGG-19, STR-03, STR-07, STR-08, WIN-05: counters, masked signatures, strings and constants of functions."""
    got = tables.fingerprints(made(spark, sf_dir, caller, "customer", "c_custkey"))
    return got.select(key(), whole("va"), "size", "insns", "signature", F.array_join("strings", ",").alias("strings"), F.array_join(F.transform("constants", lambda c: c.cast("string")), ",").alias("constants"), "calls", "indirect_calls", "returns", "branches")


@query("feature_coverage", "SELECT count(*) AS strings, CAST(0 AS BIGINT) AS imports, count(*) AS constants, count(*) AS ngrams FROM customer")
def feature_coverage(spark, sf_dir):
    """AGG-09: how many functions have features of each kind."""
    got = tables.fingerprints(made(spark, sf_dir, caller, "customer", "c_custkey")).where("calls = 0")
    return grouping.coverage(got, ["strings", "imports", "constants", "ngrams"])


@query(
    "disassembly_listing",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, 4198400 + 5 * (c_custkey % 3 + 1) + 3 AS f FROM customer WHERE c_custkey % 3 = 0)
    SELECT id, CAST(f AS BIGINT) AS va, 'mov' AS mnemonic, 'eax, 0x500001' AS operands FROM c UNION ALL SELECT id, f + 5, 'mov', 'ecx, ' || printf('0x%x', 65536 + k) FROM c
    UNION ALL SELECT id, f + 10, 'dec', 'rcx' FROM c UNION ALL SELECT id, f + 13, 'jne', printf('0x%x', f + 10) FROM c
    """,
)
def disassembly_listing(spark, sf_dir):
    """DEC-06, MTH-03: instructions from an address on, with operands, as many as asked for."""
    found = made(spark, sf_dir, caller, "customer", "c_custkey").where("CAST(sha256 AS BIGINT) % 3 = 0")
    return tables.listing(found, 4198400 + 8, 4).select(key(), whole("va"), "mnemonic", "operands")


#: One function of each architecture: a call, a conditional branch back, a return; the call's target and the branch's.
WORDS = {
    ("aarch64", 64, "little"): "94000010 54ffffe0 d65f03c0", ("aarch64", 64, "big"): "94000010 54ffffe0 d65f03c0", ("arm", 32, "little"): "eb00000e 0afffffd e12fff1e", ("arm", 32, "big"): "eb00000e 0afffffd e12fff1e",
    ("mips", 32, "little"): "0c000410 1440fffe 03e00008", ("mips", 32, "big"): "0c000410 1440fffe 03e00008", ("mips", 64, "little"): "0c000410 1440fffe 03e00008", ("mips", 64, "big"): "0c000410 1440fffe 03e00008",
    ("ppc", 32, "big"): "48000041 4182fffc 4e800020", ("ppc", 32, "little"): "48000041 4182fffc 4e800020", ("ppc", 64, "big"): "48000041 4182fffc 4e800020", ("ppc", 64, "little"): "48000041 4182fffc 4e800020",
    ("sparc", 32, "big"): "40000010 02bfffff 81c3e008", ("sparc", 64, "big"): "40000010 02bfffff 81c3e008", ("riscv", 32, "little"): "040000ef fe000ee3 00008067", ("riscv", 64, "little"): "040000ef fe000ee3 00008067",
}
FORMS = list(WORDS)


def words_of(form) -> bytes:
    order = "little" if form[0] in ("aarch64", "riscv") else form[2]
    return b"".join(int(w, 16).to_bytes(4, order) for w in WORDS[form].split())


X86 = {16: ("e83d00 74fb c3", 0x40, 3), 32: ("e83b000000 74f9 c3", 0x40, 5), 64: ("e83b000000 74f9 c3", 0x40, 5)}


@query(
    "decoders",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', {b}, '{e}', 'call', CAST(4096 AS BIGINT), CAST({4096 + 64} AS BIGINT)), ('{a}', {b}, '{e}', 'jump', 4100, 4096)" for a, b, e in FORMS)
    + ", "
    + ", ".join(f"('x86', {b}, 'little', 'call', 4096, 4160), ('x86', {b}, 'little', 'jump', {4096 + n}, {4096 + n + 2 + (-5 if b == 16 else -7)})" for b, (_, _, n) in X86.items())
    + ") AS t(arch, bits, endian, kind, site, target)",
)
def decoders(spark, sf_dir):
    """DEC-01, DEC-03: a call and a branch back, decoded for each of the nineteen targets."""
    rows = None
    for arch, bits, endian in [*FORMS, *(("x86", b, "little") for b in X86)]:
        body = words_of((arch, bits, endian)) if arch != "x86" else bytes.fromhex(X86[bits][0].replace(" ", ""))
        found = spark.range(1).select(F.lit("0").alias("sha256"), forge.constant(body).alias("content"))
        got = tables.code_index(found, arch=arch, bits=bits, endian=endian, base=0x1000).where("kind IN ('call', 'jump')")
        one = got.select(F.lit(arch).alias("arch"), F.lit(bits).alias("bits"), F.lit(endian).alias("endian"), "kind", whole("site"), whole("target"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


# ---- references


@query(
    "strings_with_references",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS id, 'text ' || (c_custkey % 7) || ' of it' AS text, CAST(5242881 AS BIGINT) AS va, CAST(1 AS BIGINT) AS xrefs FROM customer
    """,
)
def strings_with_references(spark, sf_dir):
    """JON-03, FLT-07, STR-01: strings with the number of code references to their starts; those that have any."""
    found = made(spark, sf_dir, caller, "customer", "c_custkey")
    placed = addresses.offset_to_va(tables.strings(found), tables.sections(found).select("sha256", "va", "fileoff", "filesize"), ["sha256"])
    got = xrefs.annotate(placed, tables.code_index(found).where("kind = 'reference'"), ["sha256"]).where("xrefs > 0")
    return got.select(key(), "text", whole("va"), "xrefs")


@query(
    "references_to_addresses",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_custkey % 3 + 1 AS n FROM customer)
    SELECT id, CAST(5242881 AS BIGINT) AS target, 'code_operand' AS via, 'imm:mov' AS kind, CAST(4198400 + 5 * n + 3 AS BIGINT) AS site, CAST(NULL AS BOOLEAN) AS aligned, CAST(1 AS BIGINT) AS total, false AS clipped FROM c
    UNION ALL SELECT id, 4198400, 'data_scan', 'ptr64', 5242881 + 13, (5242881 + 13) % 8 = 0, 1, false FROM c
    UNION ALL SELECT id, 4198400 + 5 * n + 3, 'direct_call', 'call', 4198400 + 5 * i, NULL, n, n > 2 FROM (SELECT id, n, unnest(range(0, least(n, 2))) AS i FROM c)
    """,
)
def references_to_addresses(spark, sf_dir):
    """XRF-01, XRF-03, JON-15, STR-04: code references, stored pointers and callers of addresses, at most two shown of each with exact totals."""
    found = made(spark, sf_dir, caller, "customer", "c_custkey")
    index, sections = tables.code_index(found), tables.sections(found)
    n = F.col("sha256").cast("long") % 3 + 1
    wanted = F.array(F.lit(5242881).cast("long"), F.lit(4198400).cast("long"), (F.lit(4198400) + 5 * n + 3).cast("long"))
    targets = found.select("sha256", F.explode(wanted).alias("target")).withColumn("target", F.col("target").cast(addresses.ADDRESS))
    held = tables.stored_addresses(found, targets)
    got = xrefs.to_targets(targets, index, held, sections, ["sha256"], 2)
    return got.select(key(), whole("target"), "via", "kind", whole("site"), "aligned", "total", "clipped")


@query(
    "references_to_strings",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_custkey % 3 + 1 AS n FROM customer)
    SELECT id, 'text ' || (k % 7) AS string, CAST(5242881 AS BIGINT) AS target, CAST(4198400 + 5 * n + 3 AS BIGINT) AS site FROM c
    """,
)
def references_to_strings(spark, sf_dir):
    """XRF-02, STR-02: places of a string in any encoding, and the references to them."""
    found = made(spark, sf_dir, caller, "customer", "c_custkey")
    wanted = found.select("sha256", F.concat(F.lit("text "), F.col("sha256").cast("long") % 7).alias("string"))
    places = addresses.offset_to_va(tables.string_places(found, wanted), tables.sections(found).select("sha256", "va", "fileoff", "filesize"), ["sha256"])
    refs = tables.code_index(found).where("kind = 'reference'").select("sha256", "site", F.col("target").alias("va"))
    return places.join(refs, ["sha256", "va"]).select(key(), "string", F.col("va").cast("long").alias("target"), whole("site"))


@query(
    "import_calls",
    f"SELECT CAST(p_partkey AS VARCHAR) AS id, CAST({forge.PE_BASE + 0x1000} AS BIGINT) AS site, 'k' || (p_partkey % 3) || '!Fn' || (p_partkey % 5) AS qualified FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), {forge.PE_BASE + 0x1006}, 'k' || (p_partkey % 3) || '!ord#' || (p_partkey % 100 + 1) FROM part",
)
def import_calls(spark, sf_dir):
    """JON-04, DEC-04: indirect branches through a slot are the import's."""
    code = b"\xff\x15" + struct.pack("<i", 0x2060 - 0x1006) + b"\xff\x25" + struct.pack("<i", 0x2068 - 0x100C) + b"\xc3"
    found = made(spark, sf_dir, lambda k: forge.pe(k, code))
    return tables.code_index(found).where("kind = 'import'").select(key(), whole("site"), F.col("detail").alias("qualified"))


@query(
    "capped_immediates",
    """
    WITH r AS (SELECT l_partkey % 50 + 65536 AS value, l_orderkey AS site, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_orderkey, l_suppkey, l_linenumber, l_extendedprice) AS seq, count(*) OVER (PARTITION BY l_partkey % 50) AS total FROM lineitem)
    SELECT value, site, CAST(seq AS INTEGER) AS seq, greatest(total - 24, 0) AS overflow FROM r WHERE seq <= 24
    """,
)
def capped_immediates(spark, sf_dir):
    """AGG-03, WIN-03: the first 24 sites of every immediate, with what is left out."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50 + 65536).alias("value"), F.col("l_orderkey").alias("site"), "l_suppkey", "l_linenumber", "l_extendedprice")
    return grouping.capped(rows, ["value"], ["site", "l_suppkey", "l_linenumber", "l_extendedprice"], 24).select("value", "site", "seq", "overflow")


# ---- algorithms


@query(
    "marker_encodings",
    """
    WITH m AS (SELECT DISTINCT p_partkey * 4099 AS value FROM part WHERE p_partkey % 7 = 0), h AS (SELECT value, lpad(lower(to_hex(value)), 8, '0') AS t FROM m WHERE value >= 65536)
    SELECT value, 'big' AS "order", t AS pattern FROM h UNION ALL SELECT value, 'little', substr(t, 7, 2) || substr(t, 5, 2) || substr(t, 3, 2) || substr(t, 1, 2) FROM h
    UNION ALL SELECT value, 'little64', substr(t, 7, 2) || substr(t, 5, 2) || substr(t, 3, 2) || substr(t, 1, 2) || '00000000' FROM h
    """,
)
def marker_encodings(spark, sf_dir):
    """STR-05: byte forms of numbers, from 0x10000 on."""
    markers = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select((F.col("p_partkey") * 4099).alias("value"), F.lit(32).alias("width"))
    return catalog.encodings(markers).select("value", "order", "pattern")


def hashing(k: int) -> bytes:
    """A function loads three initial words of SHA-256 and one that refers to a table; a second one refers to it, too."""
    words = [0x6A09E667, 0xBB67AE85, 0x510E527F][: k % 3 + 1]
    code = b"".join(b"\xb8" + struct.pack("<I", w) for w in words) + b"\xb9" + struct.pack("<I", 0x500000) + b"\xc3"
    code = b"\xe8" + struct.pack("<i", len(code) + 0) + code + b"\xba" + struct.pack("<I", 0x500000) + b"\xc3"
    return code_file(code, struct.pack("<II", 0x428A2F98, 0x71374491) + bytes(8))


@query(
    "algorithm_scan",
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS id, 'SHA-224/256' AS name, CAST(s_suppkey % 3 + 3 AS BIGINT) AS distinct_markers, 'identified' AS verdict, '' AS reason FROM supplier
    """,
)
def algorithm_scan(spark, sf_dir):
    """ALG-01, AGG-11, TOP-06, FLT-12: constants in data and code that identify an algorithm; leads are left out."""
    hit = tables.algorithm_hits(made(spark, sf_dir, hashing, "supplier", "s_suppkey"))
    per = hit.withColumn("name", F.concat_ws("|", "sha256", "name"))
    dims = algorithms.dimension(spark)
    named = per.select("name", F.substring_index("name", "|", -1).alias("algorithm")).distinct().join(F.broadcast(dims.withColumnRenamed("name", "algorithm")), "algorithm").drop("algorithm")
    got = catalog.verdicts(per, named).where("verdict = 'identified'")
    return got.select(F.substring_index("name", "|", 1).alias("id"), F.substring_index("name", "|", -1).alias("name"), "distinct_markers", "verdict", "reason")


@query(
    "algorithm_users",
    """
    WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey % 3 + 1 AS n FROM supplier)
    SELECT id, CAST(4198400 AS BIGINT) AS function, n + 1 AS refs FROM s UNION ALL SELECT id, 4198400 + 5 * n + 11, 1 FROM s
    """,
)
def algorithm_users(spark, sf_dir):
    """ALG-02, JON-10, AGG-12: the functions that use an algorithm's markers: immediates at their sites, tables by the references to them."""
    found = made(spark, sf_dir, hashing, "supplier", "s_suppkey")
    got = xrefs.algorithm_users(tables.algorithm_hits(found), tables.code_index(found), tables.functions(found), tables.sections(found), ["sha256"])
    return got.where("name = 'SHA-224/256'").select(key(), whole("function"), "refs")
