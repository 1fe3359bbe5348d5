"""Managed code as plain records: JVM class files, jars, and CLI metadata."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, field

from cairn.result import FormatError
from cairn.sources.cursor import Cursor

#: Bounds of what one archive or heap may yield.
MOST_ENTRIES, MOST_CLASSES, MOST_STRINGS, MOST_USER = 200_000, 50_000, 500_000, 200_000
#: Access bits by name; three bits mean something else on methods.
ACCESS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x20: "synchronized", 0x40: "volatile", 0x80: "transient", 0x100: "native", 0x200: "interface", 0x400: "abstract", 0x800: "strict", 0x1000: "synthetic", 0x2000: "annotation", 0x4000: "enum", 0x8000: "module"}
ON_METHODS, ON_CLASSES = {"volatile": "bridge", "transient": "varargs"}, {"synchronized": "super"}


def access_names(flags: int, where: str) -> list[str]:
    other = {"method": ON_METHODS, "class": ON_CLASSES}.get(where, {})
    return [other.get(n, n) for bit, n in ACCESS.items() if flags & bit]


def java_version(major: int) -> str:
    """45 is 1.1, then 1.2 to 1.4, then whole numbers."""
    return f"1.{major - 44}" if 45 <= major <= 48 else str(major - 44) if major > 48 else f"major {major}"


class Pool:
    """The constant pool; long and double constants take two places."""

    def __init__(self, c: Cursor):
        n = c.read("H")
        self.tags, self.values, i = [0] * n, [None] * n, 1
        while i < n:
            tag = c.read("B")
            if tag == 1:
                value = c.take(c.read("H")).decode("utf-8", "replace")
            elif tag in (3, 4, 5, 6):
                value = c.read({3: "i", 4: "f", 5: "q", 6: "d"}[tag])
            elif tag in (7, 8, 16, 19, 20):
                value = c.read("H")
            elif tag in (9, 10, 11, 12, 17, 18):
                value = c.read("HH")
            elif tag == 15:
                value = c.read("BH")
            else:
                raise FormatError("unknown constant tag", tag=tag, index=i)
            self.tags[i], self.values[i] = tag, value
            i += 2 if tag in (5, 6) else 1

    def at(self, i: int, *tags: int):
        if not 0 < i < len(self.tags) or (tags and self.tags[i] not in tags):
            raise FormatError("bad constant index", index=i)
        return self.values[i]

    def text(self, i: int) -> str:
        return self.at(i, 1)

    def name(self, i: int) -> str | None:
        """A class's name with dots, or None for index 0."""
        return self.text(self.at(i, 7)).replace("/", ".") if i else None

    def pair(self, i: int) -> tuple[str, str]:
        name, kind = self.at(i, 12)
        return self.text(name), self.text(kind)

    def member(self, i: int) -> tuple[str, str, str]:
        owner, pair = self.at(i, 9, 10, 11)
        return (self.name(owner), *self.pair(pair))

    def describe(self, i: int) -> str:
        """What a constant stands for, as text."""
        tag, value = self.tags[i], self.at(i)
        if tag == 7:
            return self.name(i)
        if tag == 8:
            return '"' + self.text(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        if tag in (9, 10, 11):
            owner, name, kind = self.member(i)
            return f"{owner}.{name}{kind if tag != 9 else ':' + kind}"
        if tag in (17, 18):
            name, kind = self.pair(value[1])
            return f"dynamic#{value[0]} {name}{kind}"
        return str(value)


@dataclass
class Code:
    max_stack: int
    max_locals: int
    code: bytes
    exceptions: list
    lines: list = field(default_factory=list)
    locals: list = field(default_factory=list)

    def line_for(self, pc: int) -> int | None:
        """The line of the last entry at or before the place."""
        return max(((p, line) for p, line in self.lines if p <= pc), default=(0, None))[1]

    def local_name(self, slot: int, pc: int) -> str | None:
        """The name whose range holds the place; else the slot's only name, if it has one."""
        names = {x["name"] for x in self.locals if x["slot"] == slot}
        live = [x["name"] for x in self.locals if x["slot"] == slot and x["start"] <= pc < x["start"] + x["length"]]
        return live[0] if live else names.pop() if len(names) == 1 else None


@dataclass
class Member:
    access: list
    name: str
    descriptor: str
    attributes: list
    code: Code | None = None
    constant: str | None = None
    signature: str | None = None
    throws: list = field(default_factory=list)

    @property
    def is_abstract_method(self) -> bool:
        return "abstract" in self.access and "static" not in self.access and self.code is None


@dataclass
class ClassFile:
    minor: int
    major: int
    access: list
    name: str
    parent: str | None
    interfaces: list
    fields: list
    methods: list
    pool: Pool
    source: str | None = None
    bootstraps: list = field(default_factory=list)

    def method(self, name: str, descriptor: str | None = None) -> Member | None:
        return next((m for m in self.methods if m.name == name and descriptor in (None, m.descriptor)), None)


def _code(body: Cursor, pool: Pool) -> Code:
    stack, n_locals, size = body.read("HHI")
    code = Code(stack, n_locals, body.take(size), [])
    for _ in range(body.read("H")):
        start, end, handler, kind = body.read("HHHH")
        code.exceptions.append({"start": start, "end": end, "handler": handler, "type": pool.name(kind)})
    for name, own in _attributes(body, pool):
        if name == "LineNumberTable":
            code.lines += [own.read("HH") for _ in range(own.read("H"))]
        elif name == "LocalVariableTable":
            for _ in range(own.read("H")):
                start, length, called, kind, slot = own.read("HHHHH")
                code.locals.append({"slot": slot, "start": start, "length": length, "name": pool.text(called), "descriptor": pool.text(kind)})
    return code


def _attributes(c: Cursor, pool: Pool):
    for _ in range(c.read("H")):
        name, size = c.read("HI")
        yield pool.text(name), Cursor(c.take(size))


def _members(c: Cursor, pool: Pool, where: str, full: bool) -> list[Member]:
    out = []
    for _ in range(c.read("H")):
        flags, name, kind = c.read("HHH")
        m = Member(access_names(flags, where), pool.text(name), pool.text(kind), [])
        for called, body in _attributes(c, pool):
            m.attributes.append(called)
            if not full:
                continue
            if called == "Code":
                m.code = _code(body, pool)
            elif called == "ConstantValue":
                m.constant = pool.describe(body.read("H"))
            elif called == "Signature":
                m.signature = pool.text(body.read("H"))
            elif called == "Exceptions":
                m.throws = [pool.name(body.read("H")) for _ in range(body.read("H"))]
        out.append(m)
    return out


def parse_class(data: bytes, full: bool = True) -> ClassFile:
    """A class file; without ``full`` the bodies of attributes are skipped."""
    c = Cursor(data)
    if c.read("I") != 0xCAFEBABE:
        raise FormatError("no class file")
    minor, major = c.read("HH")
    pool = Pool(c)
    flags, this, parent = c.read("HHH")
    interfaces = [pool.name(c.read("H")) for _ in range(c.read("H"))]
    found = ClassFile(minor, major, access_names(flags, "class"), pool.name(this), pool.name(parent), interfaces, _members(c, pool, "field", full), _members(c, pool, "method", full), pool)
    for called, body in _attributes(c, pool):
        if full and called == "SourceFile":
            found.source = pool.text(body.read("H"))
        elif full and called == "BootstrapMethods":
            for _ in range(body.read("H")):
                method, n = body.read("HH")
                found.bootstraps.append((method, [body.read("H") for _ in range(n)]))
    return found


def manifest(data: bytes) -> dict[str, str]:
    """``key: value`` lines; the last value of a key counts."""
    out = {}
    for line in data.decode("utf-8", "replace").splitlines():
        key, colon, value = line.partition(":")
        if colon and key and not line.startswith(" "):
            out[key.strip()] = value.strip()
    return out


def jar_entries(data: bytes):
    """``(name, bytes or None, reason)`` of every file of an archive, in its order; unreadable ones have a reason."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError) as e:
        raise FormatError("not a zip archive", reason=str(e)) from e
    for info in archive.infolist()[:MOST_ENTRIES]:
        if info.is_dir():
            continue
        try:
            yield info.filename, archive.read(info), None
        except Exception as e:  # noqa: BLE001  (one bad entry must not hide the others)
            yield info.filename, None, f"{type(e).__name__}: {e}"


def scan_jar(data: bytes) -> dict:
    """Classes (inventory), resources, manifest, packages, and what could not be parsed."""
    out = {"classes": [], "resources": 0, "manifest": {}, "unparsed": [], "packages": {}, "truncated": False}
    for name, body, reason in jar_entries(data):
        if name == "META-INF/MANIFEST.MF" and body is not None:
            out["manifest"] = manifest(body)
        elif not name.endswith(".class"):
            out["resources"] += body is not None
        elif len(out["classes"]) >= MOST_CLASSES:
            out["truncated"] = True
        else:
            try:
                if body is None:
                    raise FormatError(reason)
                found = parse_class(body, full=False)
            except FormatError as e:
                out["unparsed"].append({"entry": name, "reason": str(e)})
                continue
            out["classes"].append({"entry": name, "name": found.name, "parent": found.parent, "java": java_version(found.major), "methods": len(found.methods), "fields": len(found.fields)})
            package = found.name.rpartition(".")[0]
            out["packages"][package] = out["packages"].get(package, 0) + 1
    return out


# ---- CLI metadata

#: Names of the metadata tables by number.
TABLES = dict(
    enumerate(
        "Module TypeRef TypeDef FieldPtr Field MethodPtr MethodDef ParamPtr Param InterfaceImpl MemberRef Constant CustomAttribute FieldMarshal DeclSecurity ClassLayout FieldLayout StandAloneSig EventMap EventPtr Event PropertyMap PropertyPtr Property MethodSemantics MethodImpl ModuleRef TypeSpec ImplMap FieldRVA EncLog EncMap Assembly AssemblyProcessor AssemblyOS AssemblyRef AssemblyRefProcessor AssemblyRefOS File ExportedType ManifestResource NestedClass GenericParam MethodSpec GenericParamConstraint".split()
    )
)


def metadata_root(data: bytes) -> dict:
    """Version and streams (name to offset and size) of a metadata root."""
    c = Cursor(data, big=False)
    if c.take(4) != b"BSJB":
        raise FormatError("no metadata root")
    _, _, _, size = c.read("HHII")
    version = c.take(size).rstrip(b"\0").decode("utf-8", "replace")
    _, n = c.read("HH")
    if n > 256:
        raise FormatError("too many streams", streams=n)
    streams = {}
    for _ in range(n):
        offset, length = c.read("II")
        name = c.text(c.at)
        c.take((len(name) + 4) // 4 * 4)
        streams[name] = (offset, length)
    return {"version": version, "streams": streams}


def identifier_heap(heap: bytes, least: int = 1) -> list[str]:
    return [s.decode("utf-8", "replace") for s in heap.split(b"\0") if len(s) >= least][:MOST_STRINGS]


def user_strings(heap: bytes) -> list[str]:
    """Length-prefixed UTF-16 runs; a place that cannot be one is skipped bytewise."""
    out, at = [], 1
    while at < len(heap) and len(out) < MOST_USER:
        first = heap[at]
        if first < 0x80:
            size, head = first, 1
        elif first & 0xC0 == 0x80 and at + 1 < len(heap):
            size, head = (first & 0x3F) << 8 | heap[at + 1], 2
        elif first & 0xE0 == 0xC0 and at + 3 < len(heap):
            size, head = (first & 0x1F) << 24 | int.from_bytes(heap[at + 1 : at + 4], "big"), 4
        else:
            size, head = -1, 1
        if size < 0 or at + head + size > len(heap):
            at += 1
            continue
        text = heap[at + head : at + head + size // 2 * 2].decode("utf-16-le", "replace")
        if text:
            out.append(text)
        at += head + size
    return out


def table_rows(data: bytes) -> dict[str, int]:
    """Row counts of the tables that a ``#~`` stream has."""
    c = Cursor(data, 8, big=False)
    valid, _ = c.read("QQ")
    return {TABLES.get(i, f"table_{i:#x}"): c.read("I") for i in range(64) if valid >> i & 1}


def parse_cli(data: bytes) -> dict:
    """Inventory of a CLI assembly inside a PE file."""
    from cairn.sources.containers import parse_pe

    image = parse_pe(data)
    c = Cursor(data, big=False)
    optional = c.go(60).read("I") + 24
    wide = c.go(optional).read("H") == 0x20B
    rva, size = c.go(optional + (112 if wide else 96) + 14 * 8).read("II")
    if not rva:
        raise FormatError("no CLI header")

    def at(rva):
        for s in image.sections:
            if s.va - image.image_base <= rva < s.va - image.image_base + s.filesize:
                return s.fileoff + rva - (s.va - image.image_base)
        raise FormatError("address outside the sections", rva=rva)

    _, major, minor, meta, meta_size, flags, token = c.go(at(rva)).read("IHHIIII")
    start = at(meta)
    root = metadata_root(data[start : start + meta_size])
    heap = {n: data[start + o : start + o + s] for n, (o, s) in root["streams"].items()}
    return {
        "runtime": f"{major}.{minor}",
        "version": root["version"],
        "flags": flags,
        "entry": {"table": TABLES.get(token >> 24, ""), "row": token & 0xFFFFFF} if token else None,
        "streams": {n: s for n, (_, s) in root["streams"].items()},
        "table_rows": table_rows(heap["#~"]) if "#~" in heap else {},
        "identifiers": identifier_heap(heap.get("#Strings", b"")),
        "user_strings": user_strings(heap.get("#US", b"")),
    }
