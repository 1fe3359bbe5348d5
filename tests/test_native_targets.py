"""Decoders of the fixed-width targets, 16-bit code, operands as text, index warnings, control flow."""

import pytest

from cairn.plans import readers
from cairn.sources import algorithms, containers, native


def decoded(text, arch, bits, endian="little", va=0x1000):
    data = bytes.fromhex(text.replace(" ", ""))
    return [(i.mnemonic, native.text_of(data[i.va - va : i.va - va + i.size], i, arch, bits), i.is_call, i.is_jump, i.is_return, i.target, i.immediate, i.memory) for i in native.sweep(data, va, arch, bits, endian)]


@pytest.mark.parametrize("form", readers.FORMS)
def test_call_branch_and_return_of_every_target(form):
    got = [(i.is_call, i.is_jump, i.is_return, i.target) for i in native.sweep(readers.words_of(form), 0x1000, *form)]
    assert got == [(True, False, False, 0x1040), (False, True, False, 0x1000), (False, False, True, None)]
    assert native.supported(*form)


def test_nineteen_targets():
    forms = [(a, b, e) for a in ("x86", "arm", "aarch64", "mips", "ppc", "sparc", "riscv", "ia64") for b in (16, 32, 64) for e in ("little", "big")]
    assert sum(native.supported(*f) for f in forms) == 19


def test_immediates_and_relative_addresses():
    assert decoded("00000090 200080d2 41000058", "aarch64", 64)[0][-1] == 0x1000
    assert [r[6] for r in decoded("200080d2 e00fc0d2 00040091", "aarch64", 64)] == [1, 0x7F << 32, 1]
    assert decoded("04009fe5", "arm", 32)[0][-1] == 0x100C and decoded("ff0403e3", "arm", 32)[0][6] == 0x34FF
    assert [r[6] for r in decoded("3c011234 34215678", "mips", 32, "big")] == [0x12340000, 0x5678]
    assert [r[6] for r in decoded("3c601234 3863fffc", "ppc", 32, "big")] == [0x12340000, -4]
    assert decoded("03000010", "sparc", 32, "big")[0][6] == 0x4000
    assert decoded("b7120000 97020000", "riscv", 64)[0][6] == 0x1000 and decoded("97020000", "riscv", 64)[0][-1] == 0x1000
    assert decoded("8280 01a0 0100", "riscv", 64)[0][4] and decoded("01a0", "riscv", 64)[0][5] == 0x1000


def test_operands_as_text():
    assert [r[:2] for r in decoded("48 8b 05 20000000 b8 78563412 83c005 48895c2408 ff1510000000 0fb6c1 8d048d10000000 6bc803 d1e0 f7d8 50 4154", "x86", 64)] == [
        ("mov", "rax, [rip + 0x20]"), ("mov", "eax, 0x12345678"), ("add", "eax, 0x5"), ("mov", "[rsp + 0x8], rbx"), ("call", "[rip + 0x10]"), ("movzx", "eax, cl"), ("lea", "eax, [rcx*4 + 0x10]"),
        ("imul", "ecx, eax, 0x3"), ("shl", "eax, 1"), ("neg", "eax"), ("push", "rax"), ("push", "r12"),
    ]
    assert [r[:2] for r in decoded("b83412 8b160001 8b4704 66b878563412 8b00", "x86", 16)] == [("mov", "ax, 0x1234"), ("mov", "dx, [0x100]"), ("mov", "ax, [bx + 0x4]"), ("mov", "eax, 0x12345678"), ("mov", "ax, [bx + si]")]
    assert decoded("e80300", "x86", 16)[0][5] == 0x1006


def test_spans_of_nested_sections():
    inside = native.Spans([containers.Section("a", 0x1000, 0x1000, 0, 0), containers.Section("b", 0x1100, 0x10, 0, 0), containers.Section("c", 0x5000, 1, 0, 0)])
    assert [inside(v) for v in (0xFFF, 0x1000, 0x1200, 0x1FFF, 0x2000, 0x5000, 0x5001)] == [False, True, True, True, False, True, False]


def test_index_warnings():
    image = containers.raw_image(bytes(range(256)) * 16, "x86", 64)
    data = bytes(range(256)) * 16
    assert [w["code"] for w in native.index_warnings(image, data)] == ["packed_sections_skipped"]
    assert [w["code"] for w in native.index_warnings(image, data, True)] == ["packed_sections_included"]
    odd = containers.raw_image(b"\0" * 16, "ia64", 64)
    assert [w["code"] for w in native.index_warnings(odd, b"\0" * 16)] == ["no_decoder"]
    many = [("reference", i, 7, "imm:mov") for i in range(native.MOST_SITES + 1)] + [("truncated", 0, None, "")]
    assert {w["code"] for w in native.index_warnings(containers.raw_image(b"\x90", "x86", 64), b"\x90", rows=many)} == {"refs_clipped", "index_truncated"}


def test_constants_follow_from_the_specifications():
    marks = {name: {label: value for label, value, _ in constants} for name, _, _, constants, _, _ in algorithms.CATALOGUE}
    assert marks["MD5"]["sine 1"] == 0xD76AA478 and marks["MD5"]["sine 64"] == 0xEB86D391
    assert marks["SHA-1"]["round 0"] == 0x5A827999 and marks["SHA-1"]["round 3"] == 0xCA62C1D6
    assert marks["SHA-224/256"]["state 7"] == 0x5BE0CD19 and marks["SHA-224/256"]["round 63"] == 0xC67178F2 and marks["SHA-224/256"]["short state 0"] == 0xC1059ED8
    assert marks["SHA-384/512"]["round 0"] == 0x428A2F98D728AE22 and marks["SHA-3 / Keccak"]["round 2"] == 0x800000000000808A
    assert marks["Blowfish"]["pi 3"] == 0x03707344 and marks["TEA / XTEA / XXTEA"] == {"delta": 0x9E3779B9, "sum of 32": 0xC6EF3720}
    assert marks["AES / Rijndael"]["round table"] == 0xC66363A5 and marks["AES / Rijndael"]["inverse table"] == 0x51F4A750
    assert marks["CRC-32 (IEEE)"]["entry 1"] == 0x77073096 and marks["CRC-32C (Castagnoli)"]["entry 1"] == 0xF26B8303
    assert marks["secp256k1 / Bitcoin"]["low word of the prime"] == 0xFFFFFC2F and marks["Curve25519"]["a24"] == 121_665
    box = algorithms.substitution()
    assert sorted(box) == list(range(256)) and box[:4] == [0x63, 0x7C, 0x77, 0x7B]
    assert len(algorithms.CATALOGUE) == 22 and all(len(telling) == 0 or least >= 2 for _, _, least, _, _, telling in algorithms.CATALOGUE)
