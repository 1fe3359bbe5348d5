"""Files made from numbers, for the queries of the readers: PE, ELF, Mach-O, archives, class files, assemblies.

Each maker takes the number of a row and returns the file's bytes; the queries'
SQL says what must be read from it.
"""

from __future__ import annotations

import io
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(df, key: str, maker):
    """``sha256`` (the key as text) and ``content`` of one file for every row."""

    @F.arrow_udf(T.BinaryType())
    def made(keys: pa.Array) -> pa.Array:
        return pa.array([maker(k) for k in keys.to_pylist()], pa.binary())

    return df.select(F.col(key).cast("string").alias("sha256"), made(F.col(key)).alias("content"))


def at(size: int, parts: dict[int, bytes]) -> bytes:
    """Bytes of a size with parts at places."""
    out = bytearray(size)
    for place, part in parts.items():
        out[place : place + len(part)] = part
    return bytes(out)


PE_BASE = 0x140000000


def pe(k: int, code: bytes = b"\xc3", more: dict[int, bytes] | None = None, directories: dict[int, tuple[int, int]] | None = None) -> bytes:
    """A 64-bit image: ``.text`` at 0x1000 (file 0x400), ``.data`` at 0x2000 (file 0x600); two imports, two exports (one a forwarder); a library if ``k`` is odd."""
    text = {0x400: code.ljust(0x200, b"\xcc")}
    rva, off = 0x2000, 0x600

    def here(place):
        return place - rva + off

    library, function = f"K{k % 3}.DLL".encode() + b"\0", b"\x05\x00" + f"Fn{k % 5}".encode() + b"\0"
    exported = f"Exp{k % 4}".encode() + b"\0"
    thunks = struct.pack("<QQQ", 0x2080, 1 << 63 | (k % 100 + 1), 0)
    data = {
        here(0x2000): struct.pack("<IIIII", 0x2040, 0, 0, 0x20A0, 0x2060) + bytes(20),
        here(0x2040): thunks, here(0x2060): thunks, here(0x2080): function, here(0x20A0): library,
        here(0x2100): bytes(16) + struct.pack("<IIIIII", 7, 2, 1, 0x2140, 0x2150, 0x2160),
        here(0x2140): struct.pack("<II", 0x1000, 0x2108), here(0x2150): struct.pack("<I", 0x2170), here(0x2160): struct.pack("<H", 0), here(0x2170): exported,
        **{here(p): v for p, v in (more or {}).items()},
    }
    dirs = {0: (0x2100, 0x40), 1: (0x2000, 40), **(directories or {})}
    optional = struct.pack("<HBBIIIII", 0x20B, 14, 0, 0x200, 0x400, 0, 0x1000, 0x1000) + struct.pack("<QIIHHHHHHIIIIHHQQQQII", PE_BASE, 0x1000, 0x200, 6, 0, 0, 0, 6, 0, 0, 0x4000, 0x400, 0, 3, 0, 1 << 20, 4096, 1 << 20, 4096, 0, 16)
    optional += b"".join(struct.pack("<II", *dirs.get(i, (0, 0))) for i in range(16))
    head = struct.pack("<4sHHIIIHH", b"PE\0\0", 0x8664, 2, 0, 0, 0, len(optional), 0x2022 if k % 2 else 0x22)

    def section(name, size, place, offset, mode):
        return name.ljust(8, b"\0") + struct.pack("<IIIIIIHHI", size, place, 0x200 if offset == 0x400 else 0x400, offset, 0, 0, 0, 0, mode)

    table = section(b".text", len(code), 0x1000, 0x400, 0x60000020) + section(b".data", 0x400, 0x2000, 0x600, 0xC0000040)
    return at(0xA00, {0: b"MZ", 60: struct.pack("<I", 0x80), 0x80: head + optional + table, **text, **data})


def elf(k: int, code: bytes = b"\xc3\x90\x90\x90") -> bytes:
    """With section headers, symbols, a dynamic symbol table and a needed library: 64-bit little-endian x86 if ``k`` is even, else 32-bit big-endian PowerPC."""
    wide = k % 2 == 0
    o = "<" if wide else ">"
    word = "Q" if wide else "I"
    strings = b"\0" + b"main\0" + f"fn{k % 7}".encode() + b"\0" + f"imp{k % 5}".encode() + b"\0" + f"lib{k % 3}.so.6".encode() + b"\0"
    main, fn, imp, lib = (strings.index(x) for x in (b"main", b"fn", b"imp", b"lib"))

    def symbol(name, value, size, info, section):
        return struct.pack(o + "IBBHQQ", name, info, 0, section, value, size) if wide else struct.pack(o + "IIIBBH", name, value, size, info, 0, section)

    base = 0x10000
    symtab = symbol(0, 0, 0, 0, 0) + symbol(main, base + 0x200, 4, 0x12, 1) + symbol(fn, base + 0x202, k % 9, 0x11, 1)
    dynsym = symbol(0, 0, 0, 0, 0) + symbol(imp, 0, 0, 0x12, 0) + symbol(fn, base + 0x202, 2, 0x12, 1)
    dynamic = struct.pack(o + word * 4, 1, lib, 0, 0)
    names = b"\0.text\0.bss\0.symtab\0.strtab\0.dynsym\0.dynamic\0.shstrtab\0"
    places, at_ = {}, 0x200
    for name, body in ((".text", code), (".symtab", symtab), (".strtab", strings), (".dynsym", dynsym), (".dynamic", dynamic), (".shstrtab", names)):
        places[name] = (at_, body)
        at_ += -(-len(body) // 16) * 16
    entry = 24 if wide else 16

    def header(name, kind, flags, va, off, size, link, item):
        return struct.pack(o + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), names.index(name), kind, flags, va, off, size, link, 0, 1, item)

    def of(name, kind, flags, va, link=0, item=0):
        return header(name.encode(), kind, flags, va, places[name][0], len(places[name][1]), link, item)

    sections = header(b"\0", 0, 0, 0, 0, 0, 0, 0) + of(".text", 1, 6, base + 0x200) + header(b".bss", 8, 3, base + 0x8000, 0x600, 0x100 + k % 16, 0, 0)
    sections += of(".symtab", 2, 0, 0, 4, entry) + of(".strtab", 3, 0, 0) + of(".dynsym", 11, 2, base + places[".dynsym"][0], 4, entry) + of(".dynamic", 6, 3, base + places[".dynamic"][0], 4, 16 if wide else 8) + of(".shstrtab", 3, 0, 0)
    ident = b"\x7fELF" + (b"\x02\x01\x01" if wide else b"\x01\x02\x01") + bytes(9)
    size = 64 if wide else 52
    head = struct.pack(o + "HHI" + word * 3 + "IHHHHHH", 2, 62 if wide else 20, 1, base + 0x200, size, at_, 0, size, 56 if wide else 32, 1, 64 if wide else 40, 8, 7)
    load = struct.pack("<IIQQQQQQ", 1, 5, 0, base, base, 0x600, 0x600, 0x1000) if wide else struct.pack(">IIIIIIII", 1, 0, base, base, 0x600, 0x600, 5, 0x1000)
    return at(at_ + len(sections), {0: ident + head + load, at_: sections, **{p: b for p, b in places.values()}})


def macho(k: int, code: bytes = b"\xc0\x03\x5f\xd6") -> bytes:
    """64-bit little-endian AArch64: a segment with one section behind ``__PAGEZERO``, two symbols, a library, an entry."""
    strings = b"\0" + b"_main\0" + f"_ext{k % 6}".encode() + b"\0"
    base, text = 0x100000000, 0x800
    lib = f"/usr/lib/lib{k % 4}.dylib".encode() + b"\0"
    lib = lib.ljust(-(-len(lib) // 8) * 8, b"\0")

    def segment(name, va, vsize, off, size, mode, sections=b"", n=0):
        return struct.pack("<II16sQQQQIIII", 0x19, 72 + len(sections), name, va, vsize, off, size, mode, mode, n, 0) + sections

    inner = struct.pack("<16s16sQQIIIIIIII", b"__text", b"__TEXT", base + text, len(code), text, 2, 0, 0, 0x80000400, 0, 0, 0)
    table = struct.pack("<IBBHQ", 1, 0x0F, 1, 0, base + text) + struct.pack("<IBBHQ", 7, 0x01, 0, 0, 0)
    commands = [
        segment(b"__PAGEZERO", 0, base, 0, 0, 0), segment(b"__TEXT", base, 0x1000, 0, 0x1000, 5, inner, 1), struct.pack("<IIIIII", 2, 24, 0x900, 2, 0x940, len(strings)),
        struct.pack("<IIIIII", 0xC, 24 + len(lib), 24, 0, 0, 0) + lib, struct.pack("<IIQQ", 0x80000028, 24, text, 0),
    ]
    body = b"".join(commands)
    head = b"\xcf\xfa\xed\xfe" + struct.pack("<IIIIIII", 0x100000C, 0, 6 if k % 2 else 2, len(commands), len(body), 0, 0)
    return at(0x1000, {0: head + body, text: code, 0x900: table, 0x940: strings})


class Pool:
    """A class file's constant pool being filled."""

    def __init__(self):
        self.items, self.known, self.size = [], {}, 1

    def add(self, data: bytes, places: int = 1) -> int:
        if data not in self.known:
            self.known[data] = self.size
            self.items.append(data)
            self.size += places
        return self.known[data]

    def text(self, s: str) -> int:
        raw = s.encode()
        return self.add(struct.pack(">BH", 1, len(raw)) + raw)

    def name(self, s: str) -> int:
        return self.add(struct.pack(">BH", 7, self.text(s)))

    def string(self, s: str) -> int:
        return self.add(struct.pack(">BH", 8, self.text(s)))

    def long(self, n: int) -> int:
        return self.add(struct.pack(">Bq", 5, n), 2)

    def member(self, tag: int, owner: str, name: str, kind: str) -> int:
        pair = self.add(struct.pack(">BHH", 12, self.text(name), self.text(kind)))
        return self.add(struct.pack(">BHH", tag, self.name(owner), pair))

    def field(self, owner, name, kind) -> int:
        return self.member(9, owner, name, kind)

    def method(self, owner, name, kind) -> int:
        return self.member(10, owner, name, kind)


def class_file(name: str, methods=(), fields=(), parent: str = "java/lang/Object", interfaces=(), access: int = 0x21, major: int = 52, pool: Pool | None = None, source: str | None = None) -> bytes:
    """Methods: ``(access, name, descriptor, code or None, exceptions, lines, locals)``; fields: ``(access, name, descriptor)``."""
    p = pool or Pool()
    this, above = p.name(name), p.name(parent) if parent else 0
    faces = [p.name(i) for i in interfaces]
    rows = []
    for flags, called, kind, code, exceptions, lines, names in methods:
        attributes = b""
        if code is not None:
            tables = [struct.pack(">HHHH", *e[:3], p.name(e[3]) if e[3] else 0) for e in exceptions]
            inner = []
            if lines:
                body = struct.pack(">H", len(lines)) + b"".join(struct.pack(">HH", *x) for x in lines)
                inner.append(struct.pack(">HI", p.text("LineNumberTable"), len(body)) + body)
            if names:
                body = struct.pack(">H", len(names)) + b"".join(struct.pack(">HHHHH", a, n, p.text(x), p.text(t), slot) for a, n, x, t, slot in names)
                inner.append(struct.pack(">HI", p.text("LocalVariableTable"), len(body)) + body)
            body = struct.pack(">HHI", 8, 8, len(code)) + code + struct.pack(">H", len(tables)) + b"".join(tables) + struct.pack(">H", len(inner)) + b"".join(inner)
            attributes = struct.pack(">HI", p.text("Code"), len(body)) + body
        rows.append(struct.pack(">HHHH", flags, p.text(called), p.text(kind), 1 if code is not None else 0) + attributes)
    held = [struct.pack(">HHHH", flags, p.text(called), p.text(kind), 0) for flags, called, kind in fields]
    tail = struct.pack(">H", 0) if source is None else struct.pack(">HHIH", 1, p.text("SourceFile"), 2, p.text(source))
    body = struct.pack(">HHHH", access, this, above, len(faces)) + b"".join(struct.pack(">H", f) for f in faces)
    body += struct.pack(">H", len(held)) + b"".join(held) + struct.pack(">H", len(rows)) + b"".join(rows) + tail
    return struct.pack(">IHHH", 0xCAFEBABE, 0, major, p.size) + b"".join(p.items) + body


def jar(k: int) -> bytes:
    """Classes in two packages (``k % 3 + 1`` and one), a resource, a manifest (a key twice), and a damaged class if ``k`` is even."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:

        def put(name, data):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)

        put("META-INF/MANIFEST.MF", f"Manifest-Version: 1.0\r\nMain-Class: demo.Old\r\nMain-Class: demo.M{k % 4}\r\n\r\n")
        for i in range(k % 3 + 1):
            put(f"demo/C{i}.class", class_file(f"demo/C{i}", major=45 + k % 20))
        put("other/D.class", class_file("other/D"))
        put("res/a.txt", "text")
        if k % 2 == 0:
            put("demo/Bad.class", b"\xca\xfe\xba\xbe\x00\x00")
    return out.getvalue()


def assembly(k: int) -> bytes:
    """A CLI assembly: three streams and two tables; identifiers and user strings by ``k``."""
    strings = b"\0" + f"Type{k % 6}".encode() + b"\0Main\0"
    strings = strings.ljust(-(-len(strings) // 4) * 4, b"\0")
    text = f"hello {k % 8}".encode("utf-16-le")
    user = b"\0" + bytes([len(text) + 1]) + text + b"\0"
    user = user.ljust(-(-len(user) // 4) * 4, b"\0")
    tables = struct.pack("<IBBBBQQ", 0, 2, 0, 0, 1, 1 << 0 | 1 << 2 | 1 << 6, 0) + struct.pack("<III", 1, k % 5 + 1, 3)
    names = (b"#~\0\0", tables), (b"#Strings\0\0\0\0", strings), (b"#US\0", user)
    version = b"v4.0.30319\0\0"
    head = struct.pack("<4sHHII", b"BSJB", 1, 1, 0, len(version)) + version + struct.pack("<HH", 0, 3)
    start = len(head) + sum(8 + len(n) for n, _ in names)
    listed, body = b"", b""
    for name, data in names:
        listed += struct.pack("<II", start + len(body), len(data)) + name
        body += data
    meta = head + listed + body
    cor = struct.pack("<IHHIIII", 72, 2, 5, 0x2240, len(meta), 1, 0x06000001)
    return pe(k, more={0x2200: cor, 0x2240: meta}, directories={14: (0x2200, 72)})


#: Bodies of a method ``run(I)I`` (parameter ``n``) and the Java that they were compiled from, by kind; ``c`` is a constant of 0 to 99.
def bodies(c: int, pool: Pool):
    out = pool.method("java/lang/Math", "abs", "(I)I")
    build, make = pool.name("java/lang/StringBuilder"), pool.method("java/lang/StringBuilder", "<init>", "()V")
    add_text, add_int = pool.method("java/lang/StringBuilder", "append", "(Ljava/lang/String;)Ljava/lang/StringBuilder;"), pool.method("java/lang/StringBuilder", "append", "(I)Ljava/lang/StringBuilder;")
    to_text, size = pool.method("java/lang/StringBuilder", "toString", "()Ljava/lang/String;"), pool.method("java/lang/String", "length", "()I")

    def h(n):
        return struct.pack(">H", n)

    push = bytes([0x10, c])
    return {
        # if (n > c) return n - c; else return c - n;
        "if": (b"\x1a" + push + b"\xa4\x00\x08\x1a" + push + b"\x64\xac" + push + b"\x1a\x64\xac", ()),
        # return n < c ? c : n;
        "ternary": (b"\x1a" + push + b"\xa2\x00\x08" + push + b"\xa7\x00\x04\x1a\xac", ()),
        # int i = 0; do the sum: while (n > c) { i += n; n--; } return i;
        "while": (b"\x03\x3c\x1a" + push + b"\xa4\x00\x0d\x1b\x1a\x60\x3c\x84\x00\xff\xa7\xff\xf3\x1b\xac", ()),
        # switch (n) { case c: return 1; case 500: return 2; default: return 0; }
        "switch": (b"\x1a\xab\x00\x00" + struct.pack(">iiiiii", 31, 2, c, 27, 500, 29) + b"\x04\xac\x05\xac\x03\xac", ()),
        # try { return Math.abs(n); } catch (RuntimeException e) { return c; }
        "try": (b"\x1a\xb8" + h(out) + b"\xac\x4c" + push + b"\xac", ((0, 5, 5, "java/lang/RuntimeException"),)),
        # return ("n" + n).length();
        "concat": (b"\xbb" + h(build) + b"\x59\xb7" + h(make) + bytes([0x12, pool.string(f"n{c}")]) + b"\xb6" + h(add_text) + b"\x1a\xb6" + h(add_int) + b"\xb6" + h(to_text) + b"\xb6" + h(size) + b"\xac", ()),
        # return n * c + (n << 3 & c);
        "arithmetic": (b"\x1a" + push + b"\x68\x1a\x06\x78" + push + b"\x7e\x60\xac", ()),
        # a call of itself: return run(n - c);
        "call": (b"\x1a" + push + b"\x64\xb8" + h(pool.method("demo/M", "run", "(I)I")) + b"\xac", ()),
    }


KINDS = ("if", "ternary", "while", "switch", "try", "concat", "arithmetic", "call")


def method_class(k: int) -> bytes:
    """``demo/M`` with a static ``run(int n)`` of one kind, with lines and names."""
    pool = Pool()
    pool.string(f"n{k // 8 % 100}")  # a low place, so that a short load reaches it
    code, exceptions = bodies(k // 8 % 100, pool)[KINDS[k % 8]]
    names = [(0, len(code), "n", "I", 0)]
    return class_file("demo/M", [(0x9, "run", "(I)I", code, exceptions, [(0, 10), (1, 11)], names)], pool=pool, source="M.java")


def constant(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))
