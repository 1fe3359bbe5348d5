import io
import random
import shutil
import struct
import subprocess
import zipfile
from pathlib import Path

import pytest

from cairn.result import AddressError, FormatError, TargetError, UnsupportedError
from cairn.sources import containers, managed, native, tables

FIXTURES = Path(__file__).parent / "fixtures"


def minimal_elf(code=b"\x55\x48\x89\xe5\xc3", offset=0x1000, base=0x401000):
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, base, 64, 0, 0, 64, 56, 1, 64, 0, 0)
    segment = struct.pack("<IIQQQQQQ", 1, 5, offset, base, base, len(code), len(code) + 64, 0x1000)
    return (head + segment).ljust(offset, b"\0") + code


def minimal_pe(code=b"\xff\x15\x00\x30\x40\x00\xc3"):
    """A 32-bit file with code, and imports of one function by name and one by number."""
    imports = bytearray(0x200)
    struct.pack_into("<IIIII", imports, 0, 0x3080, 0, 0, 0x3040, 0x3000 + 0x100)
    imports[0x40:0x4D] = b"KERNEL32.dll\0"
    struct.pack_into("<III", imports, 0x80, 0x3060, 0x80000007, 0)
    imports[0x62:0x6E] = b"ExitProcess\0"
    struct.pack_into("<III", imports, 0x100, 0x3060, 0x80000007, 0)
    sections = b"".join(
        name.ljust(8, b"\0") + struct.pack("<IIIIIIHHI", vsize, rva, 0x200, at, 0, 0, 0, 0, mode)
        for name, vsize, rva, at, mode in ((b".text", 0x400, 0x1000, 0x400, 0x60000020), (b".idata", 0x200, 0x3000, 0x600, 0xC0000040))
    )
    optional = struct.pack("<HBBIIIIIIIII", 0x10B, 0, 0, 0, 0, 0, 0x1000, 0x1000, 0x2000, 0x400000, 0x1000, 0x200)
    optional = optional.ljust(92, b"\0") + struct.pack("<I", 16) + struct.pack("<IIII", 0, 0, 0x3000, 40) + bytes(14 * 8)
    head = b"MZ".ljust(60, b"\0") + struct.pack("<I", 0x80) + bytes(64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 2, 0, 0, 0, len(optional), 0x2102)
    return (head + optional + sections).ljust(0x400, b"\0") + code.ljust(0x200, b"\x90") + bytes(imports)


def minimal_macho():
    text = b"__text".ljust(16, b"\0") + b"__TEXT".ljust(16, b"\0") + struct.pack("<QQIIIIIIII", 0x100000F00, 4, 0xF00, 0, 0, 0, 0, 0, 0, 0)
    zero = struct.pack("<II", 0x19, 72) + b"__PAGEZERO".ljust(16, b"\0") + struct.pack("<QQQQIIII", 0, 1 << 32, 0, 0, 0, 0, 0, 0)
    segment = struct.pack("<II", 0x19, 72 + 80) + b"__TEXT".ljust(16, b"\0") + struct.pack("<QQQQIIII", 1 << 32, 0x1000, 0, 0x1000, 7, 5, 1, 0) + text
    symbols = struct.pack("<IIIIII", 2, 24, 0xE00, 2, 0xE80, 32)
    main = struct.pack("<IIQQ", 0x80000028, 24, 0xF00, 0)
    commands = zero + segment + symbols + main
    data = bytearray((struct.pack("<IIIIIIII", 0xFEEDFACF, 0x1000007, 3, 2, 4, len(commands), 0, 0) + commands).ljust(0x1000, b"\0"))
    data[0xE00:0xE20] = struct.pack("<IBBHQ", 1, 0xF, 1, 0, 0x100000F00) + struct.pack("<IBBHQ", 7, 1, 0, 0, 0)
    data[0xE80:0xE90] = b"\0_main\0_printf\0\0"
    data[0xF00:0xF04] = b"\x31\xc0\xc3\x90"
    return bytes(data)


def test_elf_without_section_headers():
    image = containers.load(minimal_elf())
    (s,) = image.sections
    assert (s.va, s.fileoff, s.filesize, s.vsize, s.x, s.w) == (0x401000, 0x1000, 5, 69, True, False)
    assert image.entry == 0x401000 and image.image_base == 0x401000 and image.bits == 64 and image.notes


def test_pe_sections_and_imports():
    image = containers.load(minimal_pe())
    assert image.is_library and image.entry == 0x401000 and [s.name for s in image.sections] == [".text", ".idata"]
    assert [(i.qualified, i.slot) for i in image.imports] == [("kernel32!ExitProcess", 0x403100), ("kernel32!ord#7", 0x403104)]
    assert image.sections[0].x and not image.sections[1].x and image.sections[1].w


def test_macho_symbols_and_base():
    image = containers.load(minimal_macho())
    assert image.image_base == 1 << 32 and image.entry == 0x100000F00 and image.sections[0].name == "__TEXT,__text"
    assert [s.name for s in image.exports] == ["_main"] and [i.name for i in image.imports] == ["_printf"]


def test_formats_are_told_apart():
    assert containers.sniff(minimal_pe()) == "pe" and containers.sniff(b"MZ" + bytes(100)) == "dos_mz"
    assert containers.sniff(b"\xca\xfe\xba\xbe\0\0\0\x34") == "java_class" and containers.sniff(b"\xca\xfe\xba\xbe\0\0\0\x02") == "macho_fat"
    assert [containers.sniff(x) for x in (b"PK\x03\x04", b"\x1f\x8b\x08\0", b"!<arch>\n", b"abc", b"text")] == ["zip", "gzip", "ar", "unknown", "unknown"]


@pytest.mark.parametrize("data, error", [(b"plain text", UnsupportedError), (b"\xca\xfe\xba\xbe\0\0\0\2", UnsupportedError), (minimal_elf()[:50], FormatError), (minimal_pe()[:200], FormatError)])
def test_what_cannot_be_read_is_refused(data, error):
    with pytest.raises(error):
        containers.load(data)


def test_raw_needs_arch_and_bits():
    with pytest.raises(UnsupportedError):
        containers.load(b"abc", arch="x86")
    assert containers.load(b"abc", arch="x86", bits=32, base=0x100).sections[0].va == 0x100


def test_damaged_files_never_raise_anything_else():
    rng = random.Random(1)
    for good in (minimal_pe(), minimal_elf(), minimal_macho()):
        for _ in range(300):
            bad = bytearray(good[: rng.randrange(4, len(good))])
            for _ in range(3):
                bad[rng.randrange(min(len(bad), 400))] = rng.randrange(256)
            try:
                containers.load(bytes(bad))
            except (FormatError, UnsupportedError):
                pass


def test_packed_sections_are_warned_of_and_skipped():
    noise = random.Random(2).randbytes(16_384)
    image = containers.raw_image(noise, "x86", 32)
    assert [w["code"] for w in containers.image_warnings(image, noise)] == ["packed_exec_section"]
    assert not native.code_sections(image, noise) and native.code_sections(image, noise, include_packed=True)
    plain = b"\x55\x89\xe5\x5d\xc3" * 400
    assert not containers.image_warnings(containers.raw_image(plain, "x86", 32), plain)
    assert containers.entropy(b"") is None and containers.entropy(b"aaaa") == 0 and containers.entropy(bytes(range(256))) == 8


def test_targets_are_checked(tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "full").write_bytes(b"abc")
    for bad in ("", str(tmp_path), str(tmp_path / "none"), str(tmp_path / "empty")):
        with pytest.raises(TargetError):
            tables.check_target(bad)
    with pytest.raises(TargetError):
        tables.check_target(str(tmp_path / "full"), most=2)
    assert tables.check_target(str(tmp_path / "full")).endswith("full")
    assert AddressError("x").as_dict()["error"] == "address_error"


def test_instruction_lengths_and_targets():
    code = bytes.fromhex("55 89e5 83ec10 c745fc00000000 8b45fc 0f8401000000 90 e8f0ffffff ebdd ff1500304000 c20800 c3".replace(" ", ""))
    got = list(native.sweep(code, 0x1000, "x86", 32))
    assert [i.size for i in got] == [1, 2, 3, 7, 3, 6, 1, 5, 2, 6, 3, 1] and sum(i.size for i in got) == len(code)
    assert [i.mnemonic for i in got] == ["push", "mov", "sub", "mov", "mov", "je", "nop", "call", "jmp", "call", "ret", "ret"]
    assert got[5].target == 0x1017 and got[7].target == 0x100C and got[8].target == 0x1000 + 30 - 35 and got[9].memory == 0x403000
    wide = list(native.sweep(bytes.fromhex("488d0510000000 48b88877665544332211 0fb6c0 c5f877 c3".replace(" ", "")), 0x1000, "x86", 64))
    assert [i.size for i in wide] == [7, 10, 3, 3, 1] and wide[0].memory == 0x1017 and wide[1].immediate == 0x1122334455667788
    with pytest.raises(UnsupportedError):
        list(native.sweep(b"\0", 0, "m68k", 32))


def test_code_index_of_a_pe():
    data = minimal_pe()
    image = containers.load(data)
    rows = list(native.code_rows(image, data))
    assert ("reference", 0x401000, 0x403000, "mem:call") in rows
    with_slot = minimal_pe(b"\xff\x15\x00\x31\x40\x00\xe8\xf5\xff\xff\xff\xc3")
    rows = list(native.code_rows(containers.load(with_slot), with_slot))
    assert ("import", 0x401000, 0x403100, "kernel32!ExitProcess") in rows and ("call", 0x401006, 0x401000, "call") in rows
    assert native.function_starts(containers.load(with_slot), with_slot) == {0x401000: "entry"}


def test_masked_signature_hides_addresses_only():
    image = containers.raw_image(bytes(0x1000), "x86", 32, base=0x400000)
    code = bytes.fromhex("b810004000 b905000000 e8fbffffff a120004000 c3".replace(" ", ""))
    insns = list(native.sweep(code, 0x400000, "x86", 32))
    inside = lambda v: 0x400000 <= v < 0x401000
    assert native.masked(insns, code, inside) == "b8????????" + "b905000000" + "e8????????" + "a1????????" + "c3"
    assert native.masked(insns, code, inside, most=9) == "b8????????"
    assert image.sections[0].name == "blob"


# ---- managed code


@pytest.fixture(scope="session")
def sample(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no Java compiler")
    out = tmp_path_factory.mktemp("java")
    subprocess.run(["javac", "-g", "-d", str(out), str(FIXTURES / "Sample.java")], check=True)
    return (out / "demo" / "Sample.class").read_bytes()


def small_class(long_first=False, tag=1):
    text = lambda s: b"\x01" + struct.pack(">H", len(s)) + s
    pool = [text(b"demo/Small"), b"\x07\0\1", text(b"java/lang/Object"), b"\x07\0\3", text(b"main"), text(b"()V"), text(b"Code")]
    at = 0
    if long_first:
        at = 2
        pool = [b"\x05" + struct.pack(">q", 7), text(b"demo/Small"), b"\x07\0\3", text(b"java/lang/Object"), b"\x07\0\5", text(b"main"), text(b"()V"), text(b"Code")]
    if tag != 1:
        pool[0] = bytes([tag]) + pool[0][1:]
    body = struct.pack(">HHHIHHIBHH", 9, 5 + at, 6 + at, 0, 0, 0, 0, 0, 0, 0)
    code = struct.pack(">HHI", 1, 1, 1) + b"\xb1" + struct.pack(">HH", 0, 0)
    body = struct.pack(">HHHHHI", 9, 5 + at, 6 + at, 1, 7 + at, len(code)) + code
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, 8 + at) + b"".join(pool) + struct.pack(">HHHHHH", 0x21, 2 + at, 4 + at, 0, 0, 1) + body + b"\0\0"


@pytest.mark.parametrize("long_first", [False, True])
def test_small_class(long_first):
    c = managed.parse_class(small_class(long_first))
    assert (c.name, c.parent, managed.java_version(c.major)) == ("demo.Small", "java.lang.Object", "8")
    assert c.methods[0].name == "main" and c.methods[0].attributes == ["Code"] and c.methods[0].code.code == b"\xb1"
    assert c.access == ["public", "super"] and c.methods[0].access == ["public", "static"]


def test_bad_classes_are_refused():
    for bad in (small_class()[:-8], small_class(tag=99), b"\0\0\0\0"):
        with pytest.raises(FormatError):
            managed.parse_class(bad)


def test_jar_scan_lists_what_it_cannot_parse():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/MANIFEST.MF", "Manifest-Version: 1.0\nMain-Class: demo.Small\nMain-Class: demo.Last\n")
        z.writestr("demo/Small.class", small_class())
        z.writestr("demo/Broken.class", small_class()[:20])
        z.writestr("data.txt", "x")
    got = managed.scan_jar(out.getvalue())
    assert [c["name"] for c in got["classes"]] == ["demo.Small"] and got["resources"] == 1 and got["packages"] == {"demo": 1}
    assert got["manifest"]["Main-Class"] == "demo.Last" and [u["entry"] for u in got["unparsed"]] == ["demo/Broken.class"]
    with pytest.raises(FormatError):
        managed.scan_jar(b"no zip")


def test_cli_metadata_parts():
    names = [b"#~\0\0", b"#Strings\0\0\0\0", b"#US\0"]
    version = b"v4.0.30319\0\0"
    root = b"BSJB" + struct.pack("<HHII", 1, 1, 0, len(version)) + version + struct.pack("<HH", 0, 3) + b"".join(struct.pack("<II", 100 * i, 10 + i) + n for i, n in enumerate(names))
    got = managed.metadata_root(root)
    assert got["version"] == "v4.0.30319" and got["streams"] == {"#~": (0, 10), "#Strings": (100, 11), "#US": (200, 12)}
    tables_ = bytes(8) + struct.pack("<QQIIII", 1 | 1 << 2 | 1 << 6 | 1 << 32, 0, 1, 3, 7, 9)
    assert managed.table_rows(tables_) == {"Module": 1, "TypeDef": 3, "MethodDef": 7, "Assembly": 9}
    assert managed.identifier_heap(b"\0one\0\0two\0") == ["one", "two"]
    text = "hi there".encode("utf-16-le") + b"\0"
    long_text = ("x" * 100).encode("utf-16-le") + b"\0"
    heap = b"\0" + bytes([len(text)]) + text + bytes([0x80 | len(long_text) >> 8, len(long_text) & 0xFF]) + long_text + b"\xff\xff"
    assert managed.user_strings(heap) == ["hi there", "x" * 100]


def test_decompiled_text_says_what_the_source_says(sample):
    from cairn.jvm import cfg, decompile

    c = managed.parse_class(sample)
    text = {m.name: decompile.method_text(c, m) for m in c.methods}
    assert all(structured for _, structured in text.values())
    assert "sum += xs[i];" in text["total"][0] and "} else {" in text["total"][0] and "while (i < xs.length)" in text["total"][0]
    assert 'return "item " + name + n;' in text["label"][0]
    assert "h = h * 31L + " in text["hash"][0] and "*=" not in text["hash"][0]
    assert [f"case {k}:" in text["kind"][0] for k in (1, 50, 1000)] == [True] * 3 and "default:" in text["kind"][0]
    assert "try {" in text["parse"][0] and "catch (NumberFormatException e)" in text["parse"][0]
    assert "this.count++;" in text["tick"][0] and "return a > b ? a : b;" in text["max"][0] and "return a && b;" in text["both"][0]
    summary = cfg.summary(c.method("total").code)
    assert len(summary["loops"]) == 1 and summary["complexity"] == 3 and summary["exits"] == 1
    assert c.method("total").code.local_name(1, 0) == "xs" and c.method("total").code.line_for(0) is not None


def test_bytecode_arrays():
    from cairn.jvm import bytecode

    assert len(bytecode.OPCODES) == 202 and bytecode.NUMBER["jsr_w"] == 0xC9 and bytecode.NUMBER["iinc"] == 0x84 and bytecode.NUMBER["tableswitch"] == 0xAA
    insns, stop = bytecode.decode(bytes.fromhex("1a 9a0004 1b ac".replace(" ", "")))
    assert stop is None and insns[1].targets == (5,)
    insns, stop = bytecode.decode(b"\x00\xcb\x00")
    assert [i.op for i in insns] == ["nop"] and stop == 1
    table = b"\x1a\xaa\0\0" + struct.pack(">iii", 20, 3, 4) + struct.pack(">ii", 21, 22) + b"\xb1"
    insns, _ = bytecode.decode(table)
    assert insns[1].targets == (21, 22, 23) and insns[1].keys == (3, 4) and insns[2].op == "return"
    insns, _ = bytecode.decode(bytes.fromhex("c484 0101 fffe c415 0102".replace(" ", "")))
    assert [(i.op, i.args, i.size) for i in insns] == [("iinc", (257, -2), 6), ("iload", (258,), 4)]


# ---- tables on Spark


def test_tables_of_files(spark, tmp_path):
    for name, data in (("a.elf", minimal_elf()), ("b.exe", minimal_pe()), ("c.bin", minimal_macho()), ("d.txt", b"no image, only some text")):
        (tmp_path / name).write_bytes(data)
    found = tables.files(spark, f"file://{tmp_path}")
    assert found.count() == 4
    assert {(r.format, r.arch, r.bits) for r in tables.images(found).collect()} == {("elf", "x86", 64), ("pe", "x86", 32), ("macho", "x86", 64)}
    assert tables.sections(found).where("x").count() == 3
    assert {r.qualified for r in tables.imports(found).collect()} == {"kernel32!ExitProcess", "kernel32!ord#7", "_printf"}
    assert [r.code for r in tables.problems(found, containers.load).collect()] == ["unsupported"]
    assert {r.text for r in tables.strings(found).where("text LIKE '%only some%'").collect()} == {"no image, only some text"}
    assert tables.needles(found, {"MZ": b"MZ"}).count() == 1
    line = tables.dump(found.where("path LIKE '%d.txt'"), 3, 16).first()
    assert (line.offset, line.hex, line.text) == (3, b"image, only some".hex(), "image, only some")
    assert {r.evidence for r in tables.functions(found).collect()} == {"entry", "symbol"}
    assert tables.fingerprints(found).where("insns >= 2").count() == 3
    assert tables.disassembly(found).where("mnemonic = 'ret'").count() >= 3


def test_class_tables(spark, tmp_path, sample):
    with zipfile.ZipFile(tmp_path / "x.jar", "w") as z:
        z.writestr("demo/Sample.class", sample)
        z.writestr("demo/Small.class", small_class())
    from cairn.jvm import methods

    found = tables.files(spark, f"file://{tmp_path}", "*.jar")
    assert {r.name for r in tables.classes(found).collect()} == {"demo.Sample", "demo.Small"}
    assert tables.members(found).where("kind = 'method' AND has_code").count() == 10
    assert tables.requirements(found).where("owner = 'java.lang.Integer' AND name = 'parseInt'").count() == 1
    assert methods.decompiled(found).where("structured").count() == 10
    assert methods.instructions(found).where("op = 'iinc' AND line IS NOT NULL").count() == 3
    assert methods.control_flow(found).where("loops = 1").count() == 2


def test_a_prologue_inside_an_operand_is_none():
    from cairn.plans.readers import caller

    # the number 0x15340 has the bytes of "push rbx" with a prefix
    data = caller(0x5340)
    image = containers.load(data)
    assert native.function_starts(image, data) == {0x401000: "entry", 0x401000 + 5 * (0x5340 % 3 + 1) + 3: "call"}
    blob = bytes.fromhex("c3 b940530100 c3 000000 4053 c3 000000 554883ec10 4053 8b4053 c3".replace(" ", ""))
    assert list(native.function_starts(containers.raw_image(blob, "x86", 64), blob)) == [10, 17, 21]


def test_immediates_of_32_bit_code_are_unsigned_numbers_of_32_bits():
    code = bytes.fromhex("b8000000f0 c3".replace(" ", ""))
    assert list(native.code_rows(containers.raw_image(code, "x86", 32, base=0x1000), code)) == [("immediate", 0x1000, 0xF0000000, "mov")]


def test_a_sweep_decodes_equal_windows_once(monkeypatch):
    code = bytes.fromhex("b8010000f0 e800000000 8b0510000000 ".replace(" ", "")) * 2 + b"\xcc" * 600 + b"\x00" * 601 + b"\x66\xb8\x01"
    decode, calls = native.decode_one, []
    want, at = [], 0
    while at < len(code):
        one = decode(code, at, 0x1000 + at, 64)
        want += [one] if one else []
        at += one.size if one else 1
    monkeypatch.setattr(native, "decode_one", lambda *a: calls.append(a) or decode(*a))
    assert list(native.sweep(code, 0x1000, "x86", 64)) == want and len(want) > 900
    assert len(calls) < 150


def test_a_task_parses_equal_contents_once(spark):
    found = spark.createDataFrame([(str(i), bytearray(b"ab"[i % 2 : i % 2 + 1])) for i in range(200)], "sha256 string, content binary").coalesce(1)
    seen = []

    def parse(sha, data):
        seen.append(data)
        yield sha, data.decode(), len(seen)

    rows = tables._table(found, parse, "sha256 string, text string, calls int").collect()
    assert {(r.sha256, r.text) for r in rows} == {(str(i), "ab"[i % 2]) for i in range(200)} and max(r.calls for r in rows) == 2
