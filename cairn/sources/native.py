"""Native code: instructions of x86 (16, 32 and 64 bit), sweeps, code indexes, control flow, masked signatures.

Fixed-width architectures are decoded by ``risc``; any other target is refused
with an ``UnsupportedError``, never guessed at.  Decoders know lengths, branch
targets, immediates and memory operands, which is what indexes are made of;
operands as text are made where they are shown.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

from cairn.operators.graph import natural_loops
from cairn.result import UnsupportedError
from cairn.sources import risc
from cairn.sources.containers import PACKED, Image, Section, entropy

PREFIXES = {0xF0, 0xF2, 0xF3, 0x2E, 0x36, 0x3E, 0x26, 0x64, 0x65, 0x66, 0x67}
CONDITIONS = "o no b ae e ne be a s ns p np l ge le g".split()
ARITHMETIC = "add or adc sbb and sub xor cmp".split()
SHIFTS = "rol ror rcl rcr shl shr sal sar".split()


class Insn(NamedTuple):
    va: int
    size: int
    mnemonic: str
    target: int | None = None  # of a direct branch or call
    immediate: int | None = None  # signed
    immediate_at: tuple | None = None  # its place in the bytes, and its size
    memory: int | None = None  # absolute or instruction-relative address
    displacement_at: tuple | None = None
    kind: str | None = None  # call, jump, branch, ret or nothing; x86 tells it by the mnemonic
    operands: str = ""  # as text, where the decoder makes it anyway

    @property
    def is_call(self):
        return self.mnemonic == "call" if self.kind is None else self.kind == "call"

    @property
    def is_jump(self):
        return self.mnemonic[0] == "j" if self.kind is None else self.kind in ("jump", "branch")

    @property
    def is_unconditional(self):
        return self.mnemonic == "jmp" if self.kind is None else self.kind == "jump"

    @property
    def is_return(self):
        return self.mnemonic == "ret" if self.kind is None else self.kind == "ret"


def supported(arch: str, bits: int, endian: str) -> bool:
    return (arch, bits, endian) in {("x86", b, "little") for b in (16, 32, 64)} | risc.FORMS


#: Byte patterns that functions begin with; they count where nothing names any function.
PROLOGUES = {("x86", 32): (b"\x55\x8b\xec", b"\x55\x89\xe5", b"\x8b\xff\x55\x8b\xec"), ("x86", 64): (b"\x48\x89\x5c\x24", b"\x55\x48\x8b\xec", b"\x48\x83\xec", b"\x40\x53")}
#: Bytes that decide an x86 instruction (14 prefixes, opcode, operands), and such windows that a sweep remembers.
LONGEST, MOST_KNOWN = 40, 4096
#: Sites kept for one target, instructions of one index, and bytes of the function that a claim is verified in.
MOST_SITES, MOST_INSNS, MOST_BYTES = 256, 40_000_000, 65_536
#: Bytes of a function whose instructions are kept while its blocks are worked out; a longer one is decoded a second time instead.
LISTED = 65_536


def _one_byte(op: int, reg: int) -> tuple[str, bool, str] | None:
    """Mnemonic, whether a ModRM byte follows, and the immediate's kind: b, w, z (16/32), v (up to 64), o (address), or none."""
    low = op & 7
    if op < 0x40:
        if low < 4:
            return ARITHMETIC[op >> 3], True, ""
        if low < 6:
            return ARITHMETIC[op >> 3], False, "b" if low == 4 else "z"
        return None
    if 0x50 <= op < 0x60:
        return ("push" if op < 0x58 else "pop"), False, ""
    if 0x70 <= op < 0x80:
        return "j" + CONDITIONS[op & 15], False, "b"
    if 0x91 <= op < 0x98:
        return "xchg", False, ""
    if 0xB0 <= op < 0xC0:
        return "mov", False, "b" if op < 0xB8 else "v"
    if 0xD8 <= op < 0xE0:
        return "fpu", True, ""
    if 0xA0 <= op < 0xA4:
        return "mov", False, "o"
    group = {
        0x63: ("movsxd", True, ""), 0x68: ("push", False, "z"), 0x69: ("imul", True, "z"), 0x6A: ("push", False, "b"), 0x6B: ("imul", True, "b"),
        0x80: (ARITHMETIC[reg], True, "b"), 0x81: (ARITHMETIC[reg], True, "z"), 0x83: (ARITHMETIC[reg], True, "b"),
        0x84: ("test", True, ""), 0x85: ("test", True, ""), 0x86: ("xchg", True, ""), 0x87: ("xchg", True, ""),
        0x8D: ("lea", True, ""), 0x8F: ("pop", True, ""), 0x90: ("nop", False, ""), 0x9B: ("wait", False, ""), 0x98: ("cwde", False, ""), 0x99: ("cdq", False, ""),
        0xA8: ("test", False, "b"), 0xA9: ("test", False, "z"), 0xC2: ("ret", False, "w"), 0xC3: ("ret", False, ""), 0xC9: ("leave", False, ""), 0xCC: ("int3", False, ""), 0xCD: ("int", False, "b"),
        0xC6: ("mov", True, "b"), 0xC7: ("mov", True, "z"), 0xE8: ("call", False, "z"), 0xE9: ("jmp", False, "z"), 0xEB: ("jmp", False, "b"), 0xE3: ("jecxz", False, "b"), 0xF4: ("hlt", False, ""),
    }
    if op in group:
        return group[op]
    if 0x88 <= op <= 0x8C or op == 0x8E:
        return "mov", True, ""
    if 0xA4 <= op <= 0xAF and op not in (0xA8, 0xA9):
        return ("movs", "cmps", "stos", "lods", "scas")[(op - 0xA4) // 2 if op < 0xA8 else (op - 0xA6) // 2], False, ""
    if op in (0xC0, 0xC1, 0xD0, 0xD1, 0xD2, 0xD3):
        return SHIFTS[reg], True, "b" if op < 0xD0 else ""
    if op in (0xF6, 0xF7):
        kind = "" if reg > 1 else "b" if op == 0xF6 else "z"
        return ("test", "test", "not", "neg", "mul", "imul", "div", "idiv")[reg], True, kind
    if op in (0xFE, 0xFF):
        name = ("inc", "dec", "call", "callf", "jmp", "jmpf", "push", None)[reg]
        return (name, True, "") if name and (op == 0xFF or reg < 2) else None
    return None


def _two_byte(op: int) -> tuple[str, bool, str] | None:
    if 0x80 <= op < 0x90:
        return "j" + CONDITIONS[op & 15], False, "z"
    if 0x90 <= op < 0xA0:
        return "set" + CONDITIONS[op & 15], True, ""
    if 0x40 <= op < 0x50:
        return "cmov" + CONDITIONS[op & 15], True, ""
    if 0xC8 <= op < 0xD0:
        return "bswap", False, ""
    plain = {0x05: "syscall", 0x0B: "ud2", 0x31: "rdtsc", 0xA2: "cpuid"}
    if op in plain:
        return plain[op], False, ""
    names = {0x1E: "nop", 0x1F: "nop", 0xAF: "imul", 0xB6: "movzx", 0xB7: "movzx", 0xBE: "movsx", 0xBF: "movsx", 0xA3: "bt", 0xAB: "bts", 0xB0: "cmpxchg", 0xB1: "cmpxchg", 0xC0: "xadd", 0xC1: "xadd", 0xA5: "shld", 0xAD: "shrd", 0xBC: "bsf", 0xBD: "bsr", 0x18: "prefetch", 0xAE: "fence"}
    if op in names:
        return names[op], True, ""
    if op in (0x70, 0x71, 0x72, 0x73, 0xC2, 0xC4, 0xC5, 0xC6, 0xA4, 0xAC, 0xBA):
        return "op0f%02x" % op, True, "b"
    if 0x10 <= op < 0x18 or 0x28 <= op < 0x30 or 0x50 <= op < 0x70 or 0x74 <= op < 0x80 and op != 0x77 or op >= 0xD0:
        return "sse%02x" % op, True, ""
    return None


def decode_one(data: bytes, at: int, va: int, bits: int) -> Insn | None:
    """The instruction at a place, or None if it is none that is known."""
    start, wide, short, end = at, False, False, len(data)
    turned = False
    while at < end and data[at] in PREFIXES:
        short |= data[at] == 0x66
        turned |= data[at] == 0x67
        at += 1
    narrow = bits == 16 and not turned or bits == 32 and turned  # addresses of 16 bits
    if bits == 16:
        short = not short
    if bits == 64 and at < end and 0x40 <= data[at] < 0x50:
        wide, at = bool(data[at] & 8), at + 1
    if at >= end or at - start > 14:
        return None
    op, at = data[at], at + 1
    if bits < 64 and 0x40 <= op < 0x50:
        return Insn(va, at - start, "inc" if op < 0x48 else "dec")
    if op == 0x62 and bits == 64 and at + 3 < end:
        maps, op, at = data[at] & 7, data[at + 3], at + 4
        found = ("vec%d_%02x" % (maps, op), True, "b" if maps == 3 or op in (0x70, 0x71, 0x72, 0x73, 0xC2, 0xC4, 0xC5, 0xC6) else "")
    elif op in (0xC4, 0xC5) and at < end and (bits == 64 or data[at] >= 0xC0):
        # vector prefixes: the opcode map is in the longer form's first byte
        maps = data[at] & 31 if op == 0xC4 else 1
        at += 2 if op == 0xC4 else 1
        if at >= end or maps not in (1, 2, 3):
            return None
        op, at = data[at], at + 1
        found = ("vec%d_%02x" % (maps, op), op != 0x77, "b" if maps == 3 or op in (0x70, 0x71, 0x72, 0x73, 0xC2, 0xC4, 0xC5, 0xC6) else "")
    elif op == 0x0F:
        if at >= end:
            return None
        if data[at] in (0x38, 0x3A) and at + 1 < end:
            found, at = ("op0f%02x%02x" % (data[at], data[at + 1]), True, "b" if data[at] == 0x3A else ""), at + 2
        else:
            found, at = _two_byte(data[at]), at + 1
    else:
        found = _one_byte(op, data[at] >> 3 & 7 if at < end else 0)
    if found is None:
        return None
    name, modrm, kind = found
    memory = displacement = relative = None
    if modrm:
        if at >= end:
            return None
        mode, low, at = data[at] >> 6, data[at] & 7, at + 1
        n = (0, 1, 2 if narrow else 4, 0)[mode]
        if narrow:
            plain = mode == 0 and low == 6
            n = 2 if plain else n
        elif mode != 3 and low == 4:
            if at >= end:
                return None
            base, at = data[at] & 7, at + 1
            plain = mode == 0 and base == 5
            n = 4 if plain else n
        else:
            plain = mode == 0 and low == 5
            n = 4 if plain else n
            relative = plain and bits == 64
        if n:
            if at + n > end:
                return None
            value = int.from_bytes(data[at : at + n], "little", signed=True)
            displacement, at = (at - start, n), at + n
            if n == 4 and (plain or mode == 2):
                memory = value if relative else value & 0xFFFFFFFF
            elif narrow and plain:
                memory = value & 0xFFFF
    n = {"": 0, "b": 1, "w": 2, "z": 2 if short else 4, "v": 8 if wide else 2 if short else 4, "o": 2 if narrow else bits // 8 if bits > 16 else 4}[kind]
    if at + n > end:
        return None
    value = int.from_bytes(data[at : at + n], "little", signed=True) if n else None
    place = (at - start, n) if n else None
    size = at + n - start
    if relative:
        memory += va + size
    branch = name == "call" and not modrm or name[0] == "j" and not modrm
    if branch:
        target = (va + size + value) & ((1 << bits) - 1)
        return Insn(va, size, name, target, None, place)
    if kind == "o":
        return Insn(va, size, name, memory=value & ((1 << bits) - 1), displacement_at=place)
    return Insn(va, size, name, None, value if name != "ret" else None, place, memory, displacement)


def sweep(data: bytes, va: int, arch: str, bits: int, endian: str = "little"):
    """Instructions from the start to the end; an unknown byte is skipped."""
    if not supported(arch, bits, endian):
        raise UnsupportedError("no decoder for this target", arch=arch, bits=bits, endian=endian)
    at, x86, known = 0, arch == "x86", {}
    while at < len(data):
        if x86:
            window = data[at : at + LONGEST]
            rest = known.get(window)
            if rest is not None:
                one = Insn(va + at, *rest)
            else:
                one = decode_one(data, at, va + at, bits)
                # what depends on the place is decoded anew
                if one is not None and one.target is None and one.memory is None:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    known[window] = one[1:]
        else:
            found = risc.decode(data, at, va + at, arch, bits, endian)
            one = None
            if found:
                size, name, kind, target, immediate, memory, operands = found
                target = None if target is None else target & ((1 << bits) - 1)
                hidden = (0, size) if target is not None or immediate is not None else None
                one = Insn(va + at, size, name, target, None if target is not None else immediate, hidden, memory, (0, size) if memory is not None else None, kind, operands)
        if one is None:
            at += 1
            continue
        yield one
        at += one.size


#: Register names by number, for each width.
REGISTERS = {
    8: "al cl dl bl ah ch dh bh".split(), 16: "ax cx dx bx sp bp si di".split(), 32: "eax ecx edx ebx esp ebp esi edi".split(), 64: "rax rcx rdx rbx rsp rbp rsi rdi".split(),
}
NARROW = ("bx + si", "bx + di", "bp + si", "bp + di", "si", "di", "bp", "bx")


def _register(n: int, width: int, rex: bool) -> str:
    if n >= 8:
        return f"r{n}" + {8: "b", 16: "w", 32: "d", 64: ""}[width]
    return ("spl", "bpl", "sil", "dil")[n - 4] if width == 8 and rex and n >= 4 else REGISTERS[width][n]


def operand_text(data: bytes, i: Insn, bits: int) -> str:
    """Operands of an x86 instruction as text; of forms that indexes do not need, only what was decoded."""
    at, short, turned, rex = 0, False, False, 0
    while data[at] in PREFIXES:
        short |= data[at] == 0x66
        turned |= data[at] == 0x67
        at += 1
    if bits == 64 and 0x40 <= data[at] < 0x50:
        rex, at = data[at], at + 1
    op, two = data[at], False
    if op == 0x0F:
        at, two = at + 1, True
        op = data[at]
    at += 1
    width = 64 if rex & 8 else (32 if short else 16) if bits == 16 else 16 if short else 32
    if i.target is not None:
        return f"{i.target:#x}"
    value = "" if i.immediate is None else f"{i.immediate:#x}" if i.immediate >= 0 else f"-{-i.immediate:#x}"
    if not two:
        if 0x40 <= op < 0x50 and bits < 64:
            return _register(op & 7, width, False)
        if 0x50 <= op < 0x60 or 0xB0 <= op < 0xC0 or 0x91 <= op < 0x98:
            name = _register(op & 7 | (rex & 1) << 3, 8 if 0xB0 <= op < 0xB8 else max(width, bits) if op < 0x60 and not short else width, bool(rex))
            return f"{name}, {value}" if value else f"{name}, {_register(0, width, False)}" if 0x91 <= op < 0x98 else name
        if op < 0x40 and op & 7 in (4, 5) or op in (0xA8, 0xA9):
            return f"{_register(0, 8 if op & 1 == 0 else width, False)}, {value}"
    byte = not two and (op < 0x40 and op & 1 == 0 or op in (0x80, 0x84, 0x86, 0x88, 0x8A, 0xC0, 0xC6, 0xD0, 0xD2, 0xF6, 0xFE)) or two and 0x90 <= op < 0xA0
    known = not two and (op < 0x40 and op & 7 < 4 or op in (0x63, 0x69, 0x6B, 0x80, 0x81, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8D, 0xC0, 0xC1, 0xC6, 0xC7, 0xD0, 0xD1, 0xD2, 0xD3, 0xF6, 0xF7, 0xFE, 0xFF)) or two and (0x40 <= op < 0x50 or 0x90 <= op < 0xA0 or op in (0xAF, 0xB6, 0xB7, 0xBE, 0xBF))
    if not known or at >= len(data):
        return value or (f"[{i.memory:#x}]" if i.memory is not None else "")
    mode, low, reg = data[at] >> 6, data[at] & 7, data[at] >> 3 & 7 | (rex & 4) << 1
    at += 1
    size = 8 if byte or two and op in (0xB6, 0xBE) else 16 if two and op in (0xB7, 0xBF) else 32 if op == 0x63 and not two else width
    if op == 0xFF and not two and reg & 7 in (2, 4, 6):
        size = max(width, bits)
    if mode == 3:
        rm = _register(low | (rex & 1) << 3, size, bool(rex))
    elif bits == 16 and not turned or bits == 32 and turned:
        parts = [] if mode == 0 and low == 6 else [NARROW[low]]
        n = {0: 2 if low == 6 else 0, 1: 1, 2: 2}[mode]
        offset = int.from_bytes(data[at : at + n], "little", signed=bool(parts)) if n else 0
        rm = "[" + (" + ".join(parts) + (f" {'-' if offset < 0 else '+'} {abs(offset):#x}" if offset else "") if parts else f"{offset:#x}") + "]"
    else:
        parts, n = [], (0, 1, 4)[mode]
        wide = 32 if bits == 64 and turned else bits
        if low == 4:
            scale, index, base = data[at] >> 6, data[at] >> 3 & 7 | (rex & 2) << 2, data[at] & 7
            at += 1
            if base == 5 and mode == 0:
                n = 4
            else:
                parts.append(_register(base | (rex & 1) << 3, wide, False))
            if index != 4:
                parts.append(_register(index, wide, False) + (f"*{1 << scale}" if scale else ""))
        elif low == 5 and mode == 0:
            n = 4
            if bits == 64:
                parts.append("rip")
        else:
            parts.append(_register(low | (rex & 1) << 3, wide, False))
        offset = int.from_bytes(data[at : at + n], "little", signed=bool(parts)) if n else 0
        rm = "[" + (" + ".join(parts) + (f" {'-' if offset < 0 else '+'} {abs(offset):#x}" if offset else "") if parts else f"{offset:#x}") + "]"
    own = _register(reg, 8 if byte else width, bool(rex))
    if not two and op in (0x80, 0x81, 0x83, 0xC0, 0xC1, 0xC6, 0xC7):
        return f"{rm}, {value}"
    if not two and op in (0xD0, 0xD1, 0xD2, 0xD3):
        return f"{rm}, {'1' if op < 0xD2 else 'cl'}"
    if not two and op in (0xF6, 0xF7, 0xFE, 0xFF) or two and 0x90 <= op < 0xA0:
        return f"{rm}, {value}" if value else rm
    if not two and op in (0x69, 0x6B):
        return f"{own}, {rm}, {value}"
    first = two or op in (0x63, 0x8A, 0x8B, 0x8D) or op < 0x40 and op & 7 in (2, 3)
    return f"{own}, {rm}" if first else f"{rm}, {own}"


def text_of(data: bytes, i: Insn, arch: str, bits: int) -> str:
    """Operands as text; ``data`` are the instruction's bytes."""
    if arch == "x86":
        return operand_text(data, i, bits)
    return i.operands or ("" if i.target is None else f"{i.target:#x}") if i.target is None else ", ".join(x for x in (i.operands, f"{i.target:#x}") if x)


def code_sections(image: Image, data: bytes, include_packed: bool = False) -> list[Section]:
    """Executable sections worth decoding: packed ones are left out unless asked for."""
    found = [s for s in image.sections if s.x and s.filesize]
    return [s for s in found if include_packed or (entropy(data[s.fileoff : s.fileoff + s.filesize]) or 0) < PACKED]


class Spans:
    """Whether addresses are in an image's sections: searched in sorted starts (nested sections keep the furthest end)."""

    def __init__(self, sections):
        spans = sorted((s.va, s.va + max(s.vsize, s.filesize)) for s in sections)
        self.starts, self.ends, reach = [a for a, _ in spans], [], 0
        for _, end in spans:
            reach = max(reach, end)
            self.ends.append(reach)

    def __call__(self, value: int) -> bool:
        at = bisect_right(self.starts, value) - 1
        return at >= 0 and value < self.ends[at]


def code_rows(image: Image, data: bytes, include_packed: bool = False, most: int | None = MOST_INSNS):
    """``(kind, site, target, text)`` of one pass over ``most`` instructions (None: all): calls, jumps, indirect calls, references, imports, immediates.

    The text of a reference names the kind of its operand: ``imm``, ``imm32`` (the
    lowest 32 bits of a sign-extended number), ``mem`` or ``pcrel``.
    """
    slots = {i.slot: i.qualified for i in image.imports if i.slot is not None}
    mapped, mask, n = Spans(image.sections), (1 << image.bits) - 1, 0
    widest = (1 << max(image.bits, 32)) - 1  # a prefix makes numbers of 32 bits in 16-bit code
    for s in code_sections(image, data, include_packed):
        for i in sweep(data[s.fileoff : s.fileoff + s.filesize], s.va, image.arch, image.bits, image.endian):
            n += 1
            if most is not None and n > most:
                yield "truncated", i.va, None, str(most)
                return
            if i.target is not None:
                yield "call" if i.is_call else "jump", i.va, i.target, i.mnemonic
            elif i.is_call or i.is_unconditional:
                if i.memory in slots:
                    yield "import", i.va, i.memory, slots[i.memory]
                else:
                    yield "indirect_call" if i.is_call else "indirect_jump", i.va, None, i.mnemonic
            if i.memory is not None and mapped(i.memory):
                relative = image.arch != "x86" or image.bits == 64 and i.displacement_at and i.displacement_at[1] == 4 and i.memory > mask >> 32
                yield "reference", i.va, i.memory, f"{'pcrel' if relative else 'mem'}:{i.mnemonic}"
            if i.immediate is not None:
                value = i.immediate & widest
                if mapped(i.immediate & mask):
                    yield "reference", i.va, i.immediate & mask, f"imm:{i.mnemonic}"
                elif image.bits == 64 and i.immediate < 0 and mapped(i.immediate & 0xFFFFFFFF):
                    yield "reference", i.va, i.immediate & 0xFFFFFFFF, f"imm32:{i.mnemonic}"
                elif abs(i.immediate) > 0xFFFF:
                    yield "immediate", i.va, value, i.mnemonic


def prologues(body: bytes, arch: str, bits: int, endian: str) -> list[int]:
    """Places of prologue patterns, without those inside an instruction (its operands may look like one); what begins with a zero counts as padding, not as an instruction."""
    places = set()
    for pattern in PROLOGUES.get((arch, bits), ()):
        at = body.find(pattern)
        while at >= 0:
            places.add(at)
            at = body.find(pattern, at + 1)
    out, todo = [], sorted(places, reverse=True)
    for i in sweep(body, 0, arch, bits, endian) if todo else ():
        while todo and todo[-1] < i.va + i.size:
            at = todo.pop()
            if at <= i.va or not body[i.va]:
                out.append(at)
        if not todo:
            break
    return out + todo[::-1]


def function_starts(image: Image, data: bytes, include_packed: bool = False) -> dict[int, str]:
    """Starts by evidence: symbols, exports, entry, call targets, and, where nothing is named, prologues; only those inside executable sections."""
    found = {}
    for s in image.symbols:
        if s.kind == "func" and s.va:
            found.setdefault(s.va, "symbol")
    for s in image.exports:
        found.setdefault(s.va, "export")
    named = bool(found)
    if image.entry is not None:
        found.setdefault(image.entry, "entry")
    if supported(image.arch, image.bits, image.endian):
        for kind, _, target, _ in code_rows(image, data, include_packed, None):
            if kind == "call":
                found.setdefault(target, "call")
    if not named:
        for s in code_sections(image, data):
            body = data[s.fileoff : s.fileoff + s.filesize]
            for at in prologues(body, image.arch, image.bits, image.endian):
                found.setdefault(s.va + at, "prologue")
    inside = [(s.va, s.va + s.filesize) for s in image.sections if s.x]
    return {va: why for va, why in sorted(found.items()) if any(a <= va < b for a, b in inside)}


def index_warnings(image: Image, data: bytes, include_packed: bool = False, rows=()) -> list[dict]:
    """What an index leaves out or makes up: packed sections, a cut sweep, targets with more sites than are kept."""
    out, packed = [], [s.name for s in image.sections if s.x and s.filesize and (entropy(data[s.fileoff : s.fileoff + s.filesize]) or 0) >= PACKED]
    if packed and include_packed:
        out.append({"code": "packed_sections_included", "impact": "unreliable", "detail": ", ".join(packed)})
    elif packed:
        out.append({"code": "packed_sections_skipped", "impact": "degraded", "detail": ", ".join(packed)})
    if not supported(image.arch, image.bits, image.endian):
        out.append({"code": "no_decoder", "impact": "degraded", "detail": f"{image.arch}/{image.bits}/{image.endian}"})
    sites = Counter()
    for kind, _, target, _ in rows:
        if kind == "truncated":
            out.append({"code": "index_truncated", "impact": "degraded", "detail": f"{MOST_INSNS} instructions"})
        sites[target] += kind == "reference"
    clipped = sum(n > MOST_SITES for n in sites.values())
    if clipped:
        out.append({"code": "refs_clipped", "impact": "degraded", "detail": f"{clipped} targets have more than {MOST_SITES} sites"})
    return out


def control_flow(image: Image, data: bytes, va: int, starts: list[int]) -> dict | None:
    """Blocks (with calls and successors), edges, loops and exits of the function at an address; None if nothing is there."""
    s = next((s for s in image.sections if s.va <= va < s.va + s.filesize), None)
    if s is None:
        return None
    after = bisect_right(starts, va)
    end = min([s.va + s.filesize, *starts[after : after + 1]])
    body = data[s.fileoff + va - s.va : s.fileoff + end - s.va]

    def code():
        return trimmed(sweep(body, va, image.arch, image.bits, image.endian))

    if len(body) <= LISTED:
        listed = list(code())
        code = lambda: listed
    slots = {i.slot: i.qualified for i in image.imports if i.slot is not None}

    def called(i):
        return slots.get(i.memory) or (f"{i.target:#x}" if i.target is not None else "indirect:" + text_of(body[i.va - va : i.va - va + i.size], i, image.arch, image.bits))

    places, lead, first = bytearray(len(body) + 1), set(), None
    for i in code():
        if first is None:
            first = i.va
        places[i.va - va] = 1
        if i.is_jump and i.target is not None:
            lead.add(i.target)
        if i.is_jump or i.is_return:
            lead.add(i.va + i.size)
    if first is None:
        return None
    lead = {first} | {at for at in lead if 0 <= at - va < len(places) and places[at - va]}
    blocks, calls, n_insns = {}, {}, 0
    for i in code():
        if i.va in lead:
            start, size = i.va, 0
            calls[start] = []
        n_insns, size = n_insns + 1, size + 1
        blocks[start] = size, i
        if i.is_call:
            calls[start].append(called(i))
    succ = {}
    for start, (_, last) in blocks.items():
        go = [last.target] if last.is_jump and last.target in blocks else []
        if not last.is_return and not last.is_unconditional and last.va + last.size in blocks:
            go.append(last.va + last.size)
        succ[start] = go
    loops = natural_loops(sorted(blocks), succ, first)
    exits = sorted(b for b in blocks if not succ[b])
    n_edges = sum(map(len, succ.values()))
    rows = [{"start": b, "end": last.va + last.size, "insns": size, "terminator": last.mnemonic, "succ": succ[b], "calls": calls[b]} for b, (size, last) in sorted(blocks.items())]
    return {
        "function": va, "end": i.va + i.size, "insns": n_insns, "blocks": rows, "edges": n_edges, "complexity": n_edges - len(blocks) + 2, "exits": exits, "single_exit": len(exits) == 1,
        "loops": [{"header": x["header"], "tail": x["tail"], "size": len(x["body"]), "body": x["body"], "depth": x["depth"]} for x in loops],
    }


def masked(insns: list[Insn], data: bytes, mapped, most: int = 128) -> str:
    """Bytes as hexadecimal with ``??`` for branch distances and addresses inside the image; whole instructions only."""
    out, at = [], 0
    for i in insns:
        if at + i.size > most:
            break
        hidden = set()
        if i.target is not None and i.immediate_at:
            hidden.update(range(i.immediate_at[0], sum(i.immediate_at)))
        if i.immediate is not None and i.immediate_at and i.immediate_at[1] >= 4 and mapped(i.immediate & 0xFFFFFFFFFFFFFFFF):
            hidden.update(range(i.immediate_at[0], sum(i.immediate_at)))
        if i.memory is not None and mapped(i.memory):
            hidden.update(range(i.displacement_at[0], sum(i.displacement_at)))
        out += ["??" if n in hidden else f"{data[at + n]:02x}" for n in range(i.size)]
        at += i.size
    return "".join(out)


def trimmed(insns):
    """Without what follows the first return or jump that padding follows: it is no longer the same function."""
    last = None
    for i in insns:
        if last is not None and (last.is_return or last.is_unconditional) and i.mnemonic in ("int3", "nop"):
            return
        yield i
        last = i


def fingerprint(image: Image, data: bytes, start: int, end: int, texts: dict[int, str], imports: dict[int, str]) -> dict | None:
    """Features of one function: counters, masked signature, mnemonic n-grams, strings, imports, constants."""
    s = next((s for s in image.sections if s.va <= start < s.va + s.filesize), None)
    if s is None:
        return None
    body = data[s.fileoff + start - s.va : s.fileoff + min(end, s.va + s.filesize, start + 8192) - s.va]
    insns = list(trimmed(sweep(body, start, image.arch, image.bits, image.endian)))
    if len(insns) < 2:
        return None
    mapped = Spans(image.sections)
    names = [i.mnemonic for i in insns]
    grams = {hashlib.sha256(" ".join(names[k : k + 5]).encode()).hexdigest()[:8] for k in range(len(names) - 4)}
    touched = [v for i in insns for v in (i.memory, i.immediate) if v is not None]
    return {
        "va": start,
        "size": insns[-1].va + insns[-1].size - start,
        "insns": len(insns),
        "signature": masked(insns, body, mapped),
        "mnemonic_hash": hashlib.sha256(" ".join(names).encode()).hexdigest()[:16],
        "ngrams": sorted(grams),
        "strings": sorted({texts[v] for v in touched if v in texts}),
        "imports": sorted({imports[v] for v in touched if v in imports}),
        "constants": sorted({i.immediate for i in insns if i.immediate is not None and not -16 <= i.immediate <= 16 and not mapped(i.immediate)}),
        "calls": sum(i.is_call and i.target is not None for i in insns),
        "indirect_calls": sum(i.is_call and i.target is None for i in insns),
        "returns": sum(i.is_return for i in insns),
        "branches": sum(i.is_jump for i in insns),
    }
