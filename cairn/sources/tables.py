"""Files as tables: Spark reads the bytes, executors parse them, one row set per kind of record.

``files`` has ``path, content``; every table is keyed by ``sha256``.  A file that
cannot be parsed yields one row in ``problems`` and none elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.result import CairnError, TargetError
from cairn.sources import containers, managed, native

#: Bytes of the largest file that is read (option ``most``).
MOST_BYTES = 512 << 20
#: Rows that are handed over together.
AT_ONCE = 5000
#: Contents, and rows of them, that a task remembers.
KNOWN_BYTES, KNOWN_ROWS = 8 << 20, 16 << 10


def files(spark: SparkSession, path: str, pattern: str | None = None, most: int = MOST_BYTES, recursive: bool = False) -> DataFrame:
    """``path, sha256, size, content`` of all files under ``path`` that are neither empty nor too large."""
    if not path or not path.strip():
        raise TargetError("no path was given")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path).where((F.col("length") > 0) & (F.col("length") <= most))
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def check_target(path: str, most: int = MOST_BYTES) -> str:
    """A local file that can be read, as an absolute path; else a typed error that says why."""
    if not path or not path.strip():
        raise TargetError("no path was given")
    p = Path(path).expanduser().resolve()
    if not p.exists():
        raise TargetError("no such file", path=str(p))
    if not p.is_file():
        raise TargetError("not a file", path=str(p))
    if not 0 < p.stat().st_size <= most:
        raise TargetError("an empty file" if not p.stat().st_size else "the file is too large", path=str(p), size=p.stat().st_size, most=most)
    return str(p)


def _names(schema: str) -> list[str]:
    """Names of a schema's top-level columns."""
    out, depth, item = [], 0, ""
    for c in schema + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(item.split()[0])
            item = ""
        else:
            item += c
    return out


def _table(found: DataFrame, parse, schema: str) -> DataFrame:
    """Rows that ``parse(sha256, content)`` yields as tuples of ``schema``; small contents that a task meets again are not parsed again."""
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = {}, 0
        for pdf in batches:
            rows = []
            for sha, content in zip(pdf["sha256"], pdf["content"]):
                content = bytes(content)
                own = known.get(content)
                if own is None:
                    try:
                        own = [row[1:] for row in parse(sha, content)]
                    except CairnError:
                        own = []
                    if len(content) <= KNOWN_BYTES >> 6 and len(own) <= KNOWN_ROWS >> 6:
                        size = len(content) + len(own) * (KNOWN_BYTES // KNOWN_ROWS)
                        if held + size > KNOWN_BYTES:
                            known, held = {}, 0
                        known[content] = own
                        held += size
                rows += [(sha, *row) for row in own]
                if len(rows) >= AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return found.select("sha256", "content").mapInPandas(run, schema)


def problems(found: DataFrame, parse) -> DataFrame:
    """``sha256, code, message`` of the files that ``parse(content)`` refuses."""

    def run(batches):
        for pdf in batches:
            for sha, content in zip(pdf["sha256"], pdf["content"]):
                try:
                    parse(bytes(content))
                except CairnError as e:
                    yield pd.DataFrame([(sha, e.code, str(e))], columns=["sha256", "code", "message"])

    return found.select("sha256", "content").mapInPandas(run, "sha256 string, code string, message string")


def _big(value):
    from decimal import Decimal

    return None if value is None else Decimal(value)


def images(found: DataFrame, **raw) -> DataFrame:
    def parse(sha, data):
        i = containers.load(data, **raw)
        yield sha, i.format, i.arch, i.bits, i.endian, _big(i.image_base), _big(i.entry), i.is_library, i.needed, i.notes

    return _table(found, parse, "sha256 string, format string, arch string, bits int, endian string, image_base decimal(20,0), entry_va decimal(20,0), is_library boolean, needed array<string>, notes array<string>")


def sections(found: DataFrame, **raw) -> DataFrame:
    def parse(sha, data):
        for n, s in enumerate(containers.load(data, **raw).sections):
            e = containers.entropy(data[s.fileoff : s.fileoff + s.filesize])
            yield sha, n, s.name, _big(s.va), s.vsize, s.fileoff, s.filesize, s.r, s.w, s.x, None if e is None else round(e, 6)

    return _table(found, parse, "sha256 string, ord int, name string, va decimal(20,0), vsize long, fileoff long, filesize long, r boolean, w boolean, x boolean, entropy double")


def symbols(found: DataFrame) -> DataFrame:
    """Symbols and exports; of one address's names the last (exports after symbols) is the one to show."""

    def parse(sha, data):
        i = containers.load(data)
        for n, s in enumerate([*i.symbols, *i.exports]):
            yield sha, n, s.name, _big(s.va), s.size, s.kind, s.source

    return _table(found, parse, "sha256 string, ord int, name string, va decimal(20,0), size long, kind string, source string")


def imports(found: DataFrame) -> DataFrame:
    def parse(sha, data):
        for n, i in enumerate(containers.load(data).imports):
            yield sha, n, i.library, i.name, _big(i.slot), i.qualified

    return _table(found, parse, "sha256 string, ord int, library string, name string, slot decimal(20,0), qualified string")


_ASCII, _LE, _BE = (re.compile(p) for p in (rb"[\x09\x20-\x7e]{%d,}", rb"(?:[\x09\x20-\x7e]\x00){%d,}", rb"(?:\x00[\x09\x20-\x7e]){%d,}"))


def text_runs(data: bytes, least: int = 5, big: bool = False):
    """``(offset, encoding, text)`` of printable runs, by offset and then encoding."""
    forms = [("ascii", _ASCII, "latin-1"), ("utf-16-le", _LE, "utf-16-le")] + ([("utf-16-be", _BE, "utf-16-be")] if big else [])
    out = []
    for rank, (name, pattern, codec) in enumerate(forms):
        for m in re.finditer(pattern.pattern % least, data):
            out.append((m.start(), rank, name, m.group().decode(codec)))
    return [(at, name, text) for at, _, name, text in sorted(out)]


def strings(found: DataFrame, least: int = 5, big: bool = False) -> DataFrame:
    def parse(sha, data):
        for at, name, text in text_runs(data, least, big):
            yield sha, at, name, text

    return _table(found, parse, "sha256 string, offset long, encoding string, text string")


def needles(found: DataFrame, patterns: dict[str, bytes]) -> DataFrame:
    """Every place (overlapping ones too) of each pattern: ``sha256, label, offset``."""

    def parse(sha, data):
        for label, needle in patterns.items():
            at = data.find(needle) if needle else -1
            while at >= 0:
                yield sha, label, at
                at = data.find(needle, at + 1)

    return _table(found, parse, "sha256 string, label string, offset long")


def _wanted(found: DataFrame, wanted: DataFrame, item: str) -> DataFrame:
    """Files beside the list of what is looked for in each."""
    return found.select("sha256", "content").join(wanted.groupBy("sha256").agg(F.array_sort(F.collect_set(item)).alias("wanted")), "sha256")


def string_places(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sha256, string, offset, encoding``: every place of the strings that are wanted of each file, in ASCII and both UTF-16 orders."""

    def run(batches):
        for pdf in batches:
            rows = []
            for sha, content, texts in zip(pdf["sha256"], pdf["content"], pdf["wanted"]):
                for text in texts:
                    for name, needle in (("ascii", text.encode()), ("utf-16-le", text.encode("utf-16-le")), ("utf-16-be", text.encode("utf-16-be"))):
                        at = content.find(needle) if needle else -1
                        while at >= 0:
                            rows.append((sha, text, at, name))
                            at = content.find(needle, at + 1)
            yield pd.DataFrame(rows, columns=["sha256", "string", "offset", "encoding"])

    return _wanted(found, wanted, "string").mapInPandas(run, "sha256 string, string string, offset long, encoding string")


def stored_addresses(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sha256, target, offset, size``: where the wanted ``target`` addresses are stored as pointers, at any alignment."""

    def run(batches):
        for pdf in batches:
            rows = []
            for sha, content, targets in zip(pdf["sha256"], pdf["content"], pdf["wanted"]):
                try:
                    image = containers.load(bytes(content))
                except CairnError:
                    continue
                size = image.bits // 8
                for target in targets:
                    if 0 <= int(target) < 1 << image.bits:
                        needle = int(target).to_bytes(size, image.endian)
                        at = content.find(needle)
                        while at >= 0:
                            rows.append((sha, target, at, size))
                            at = content.find(needle, at + 1)
            yield pd.DataFrame(rows, columns=["sha256", "target", "offset", "size"])

    return _wanted(found, wanted, "target").mapInPandas(run, "sha256 string, target decimal(20,0), offset long, size int")


def dump(found: DataFrame, offset: int, length: int) -> DataFrame:
    """Rows of sixteen bytes from an offset, as hexadecimal and printable text."""
    span = F.substring("content", offset + 1, min(max(length, 1), 4096))
    rows = found.select("sha256", span.alias("b")).select("sha256", "b", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 1, F.lit(0)), F.lit(16))).alias("at"))
    line = F.expr("substring(b, at + 1, 16)")
    return rows.where(F.octet_length("b") > 0).select("sha256", (F.col("at") + offset).cast("long").alias("offset"), F.lower(F.hex(line)).alias("hex"), F.regexp_replace(F.decode(line, "ISO-8859-1"), r"[^\x20-\x7e]", ".").alias("text"))


def classes(found: DataFrame) -> DataFrame:
    def parse(sha, data):
        for entry, body in class_entries(data):
            c = managed.parse_class(body)
            yield sha, entry, c.name, c.parent, c.interfaces, c.access, managed.java_version(c.major), c.source

    return _table(found, parse, "sha256 string, entry string, name string, parent string, interfaces array<string>, access array<string>, java string, source string")


def members(found: DataFrame) -> DataFrame:
    def parse(sha, data):
        for _, body in class_entries(data):
            c = managed.parse_class(body)
            for kind, group in (("field", c.fields), ("method", c.methods)):
                for n, m in enumerate(group):
                    yield sha, c.name, kind, n, m.name, m.descriptor, m.access, "abstract" in m.access, "static" in m.access, m.code is not None

    return _table(found, parse, "sha256 string, owner string, kind string, ord int, name string, descriptor string, access array<string>, is_abstract boolean, is_static boolean, has_code boolean")


def requirements(found: DataFrame) -> DataFrame:
    """What every class refers to: classes, fields, methods, supertypes, in the order of its constants."""

    def parse(sha, data):
        n = 0
        for _, body in class_entries(data):
            c = managed.parse_class(body)
            for i, tag in enumerate(c.pool.tags):
                if tag == 7:
                    yield sha, "class", c.pool.name(i), None, None, c.name, n
                elif tag in (9, 10, 11):
                    yield (sha, "field" if tag == 9 else "method", *c.pool.member(i), c.name, n)
                n += 1
            for parent in [c.parent, *c.interfaces]:
                if parent:
                    yield sha, "supertype", parent, None, None, c.name, n
                    n += 1

    return _table(found, parse, "sha256 string, kind string, owner string, name string, descriptor string, from_class string, seq long")


def class_entries(data: bytes):
    """``(entry, bytes)`` of a class file or of the classes in an archive; unreadable or damaged ones are left out."""
    if data[:4] == b"\xca\xfe\xba\xbe":
        yield "", data
        return
    for name, body, _ in managed.jar_entries(data):
        if name.endswith(".class") and body is not None:
            try:
                managed.parse_class(body, full=False)
            except CairnError:
                continue
            yield name, body


def class_named(found: DataFrame, class_name: str) -> DataFrame:
    """``sha256, entry, content`` of one class of every archive: by its exact name, else by the end of it, the first in the archive's order."""
    wanted = class_name.replace(".", "/").removesuffix("/class")

    def parse(sha, data):
        entries = list(class_entries(data))
        for exact in (True, False):
            for entry, body in entries:
                bare = entry.removesuffix(".class")
                if not entry or (bare == wanted if exact else bare.endswith(wanted)):
                    yield sha, entry, body
                    return

    return _table(found, parse, "sha256 string, entry string, content binary")


def assemblies(found: DataFrame) -> DataFrame:
    def parse(sha, data):
        i = managed.parse_cli(data)
        yield sha, i["runtime"], i["version"], i["streams"], i["table_rows"], i["identifiers"], i["user_strings"]

    return _table(found, parse, "sha256 string, runtime string, version string, streams map<string,long>, table_rows map<string,long>, identifiers array<string>, user_strings array<string>")


def code_index(found: DataFrame, include_packed: bool = False, **raw) -> DataFrame:
    """One pass over the code: ``kind`` call, jump, import, indirect_call, indirect_jump, reference or immediate."""

    def parse(sha, data):
        for kind, site, target, text in native.code_rows(containers.load(data, **raw), data, include_packed):
            yield sha, kind, _big(site), _big(target), text

    return _table(found, parse, "sha256 string, kind string, site decimal(20,0), target decimal(20,0), detail string")


def functions(found: DataFrame, include_packed: bool = False, **raw) -> DataFrame:
    """Function starts with their evidence."""

    def parse(sha, data):
        for va, why in native.function_starts(containers.load(data, **raw), data, include_packed).items():
            yield sha, _big(va), why

    return _table(found, parse, "sha256 string, va decimal(20,0), evidence string")


def fingerprints(found: DataFrame, include_packed: bool = False, **raw) -> DataFrame:
    """One row of features per function of at least two instructions."""
    names = ["va", "size", "insns", "signature", "mnemonic_hash", "ngrams", "strings", "imports", "constants", "calls", "indirect_calls", "returns", "branches"]

    def parse(sha, data):
        image = containers.load(data, **raw)
        texts = {}
        for s in image.sections:
            for at, name, text in text_runs(data[s.fileoff : s.fileoff + s.filesize]) if not s.x else ():
                if name == "ascii":
                    texts[s.va + at] = text
        slots = {i.slot: i.qualified for i in image.imports if i.slot is not None}
        starts = sorted(native.function_starts(image, data, include_packed))
        for va, end in zip(starts, [*starts[1:], 1 << 64]):
            row = native.fingerprint(image, data, va, min(end, va + 65_536), texts, slots)
            if row:
                yield (sha, *(_big(row[n]) if n == "va" else row[n] for n in names))

    return _table(
        found,
        parse,
        "sha256 string, va decimal(20,0), size int, insns int, signature string, mnemonic_hash string, ngrams array<string>, strings array<string>, imports array<string>, constants array<long>, calls int, indirect_calls int, returns int, branches int",
    )


def disassembly(found: DataFrame, **raw) -> DataFrame:
    """One row per instruction of the executable sections that are not packed."""

    def parse(sha, data):
        image = containers.load(data, **raw)
        for s in native.code_sections(image, data):
            body = data[s.fileoff : s.fileoff + s.filesize]
            for i in native.sweep(body, s.va, image.arch, image.bits, image.endian):
                at = i.va - s.va
                own = body[at : at + i.size]
                yield sha, _big(i.va), i.size, own.hex(), i.mnemonic, native.text_of(own, i, image.arch, image.bits), _big(i.target)

    return _table(found, parse, "sha256 string, va decimal(20,0), size int, bytes string, mnemonic string, operands string, target decimal(20,0)")


def listing(found: DataFrame, address: int, count: int = 40, **raw) -> DataFrame:
    """Up to ``count`` (1 to 512) instructions from an address on, whatever kind of section it is in."""

    def parse(sha, data):
        image = containers.load(data, **raw)
        s = next((s for s in reversed(image.sections) if s.va <= address < s.va + s.filesize), None)
        if s is None:
            return
        body = data[s.fileoff + address - s.va : s.fileoff + s.filesize]
        for n, i in enumerate(native.sweep(body, address, image.arch, image.bits, image.endian)):
            if n == min(max(count, 1), 512):
                return
            own = body[i.va - address : i.va - address + i.size]
            yield sha, _big(i.va), i.size, own.hex(), i.mnemonic, native.text_of(own, i, image.arch, image.bits), _big(i.target), s.x

    return _table(found, parse, "sha256 string, va decimal(20,0), size int, bytes string, mnemonic string, operands string, target decimal(20,0), executable boolean")


def control_flow(found: DataFrame, address: int | None = None, **raw) -> DataFrame:
    """One row per function (or of the one at an address): blocks with their calls, edges, loops and exits."""

    def parse(sha, data):
        image = containers.load(data, **raw)
        starts = sorted(native.function_starts(image, data))
        for va in starts if address is None else [address]:
            row = native.control_flow(image, data, va, starts)
            if row:
                big = {b["start"]: _big(b["start"]) for b in row["blocks"]}
                blocks = [{**b, "start": big[b["start"]], "end": _big(b["end"]), "succ": [big[t] for t in b["succ"]]} for b in row["blocks"]]
                loops = [{**x, "header": big[x["header"]], "tail": big[x["tail"]], "body": [big[b] for b in x["body"]]} for x in row["loops"]]
                yield sha, _big(va), _big(row["end"]), row["insns"], blocks, row["edges"], row["complexity"], loops, [big[e] for e in row["exits"]], row["single_exit"]

    a = "decimal(20,0)"
    return _table(
        found,
        parse,
        f"sha256 string, va {a}, end {a}, insns int, blocks array<struct<start:{a},end:{a},insns:int,terminator:string,succ:array<{a}>,calls:array<string>>>, edges int, complexity int, loops array<struct<header:{a},tail:{a},size:int,body:array<{a}>,depth:int>>, exits array<{a}>, single_exit boolean",
    )


def warnings(found: DataFrame, include_packed: bool = False, indexed: bool = False, **raw) -> DataFrame:
    """``sha256, code, impact, detail``: what to know of an image and (``indexed``) of its code index."""

    def parse(sha, data):
        image = containers.load(data, **raw)
        rows = native.code_rows(image, data, include_packed) if indexed and native.supported(image.arch, image.bits, image.endian) else ()
        for w in [*containers.image_warnings(image, data), *(native.index_warnings(image, data, include_packed, rows) if indexed else [])]:
            yield sha, w["code"], w["impact"], w["detail"]

    return _table(found, parse, "sha256 string, code string, impact string, detail string")


def code_sections(found: DataFrame, include_packed: bool = False, **raw) -> DataFrame:
    """Sections by what they are good for: ``executable``, ``packed``, ``analyzable`` (worth decoding), ``holds_data``."""
    rows = sections(found, **raw)
    packed = F.col("x") & (F.coalesce("entropy", F.lit(0.0)) >= containers.PACKED)
    kept = F.col("x") & (F.col("filesize") > 0)
    return rows.withColumns({"executable": F.col("x"), "packed": packed, "analyzable": kept if include_packed else kept & ~packed, "holds_data": ~F.col("x") & (F.col("filesize") > 0)})


def jars(found: DataFrame) -> DataFrame:
    """One row per archive: numbers of classes and resources, manifest, packages, and what could not be parsed."""

    def parse(sha, data):
        got = managed.scan_jar(data)
        yield sha, len(got["classes"]), got["resources"], got["manifest"], got["packages"], [(u["entry"], u["reason"]) for u in got["unparsed"]], got["truncated"]

    return _table(found, parse, "sha256 string, classes int, resources int, manifest map<string,string>, packages map<string,int>, unparsed array<struct<entry:string,reason:string>>, truncated boolean")


def constants(found: DataFrame) -> DataFrame:
    """Constant pools: ``index, tag`` and what the constant stands for as text."""

    def parse(sha, data):
        for _, body in class_entries(data):
            c = managed.parse_class(body)
            for i, tag in enumerate(c.pool.tags):
                if tag:
                    yield sha, c.name, i, tag, c.pool.describe(i)

    return _table(found, parse, "sha256 string, owner string, index int, tag int, text string")


def lines(found: DataFrame) -> DataFrame:
    """Every instruction of every method with its line and the names of the locals that live there."""
    from cairn.jvm import bytecode

    def parse(sha, data):
        for _, body in class_entries(data):
            c = managed.parse_class(body)
            for m in c.methods:
                for i in bytecode.decode(m.code.code)[0] if m.code else ():
                    names = [m.code.local_name(slot, i.pc) for slot in range(m.code.max_locals)]
                    yield sha, c.name, m.name, m.descriptor, i.pc, m.code.line_for(i.pc), [n or "" for n in names]

    return _table(found, parse, "sha256 string, owner string, method string, descriptor string, pc int, line int, locals array<string>")


def algorithm_hits(found: DataFrame, **raw) -> DataFrame:
    """Marker hits of known algorithms, one row each; feed them to ``operators.catalog``."""
    from cairn.sources import algorithms

    def parse(sha, data):
        for h in algorithms.scan(containers.load(data, **raw), data):
            yield sha, h["name"], h["label"], h["kind"], _big(h["place"]), h["is_discriminator"]

    return _table(found, parse, "sha256 string, name string, label string, kind string, place decimal(20,0), is_discriminator boolean")
