"""Java-like text of a method: symbolic execution of blocks, then structured statements.

Blocks are run on a symbolic stack; what is left on it is handed to the
successors.  Statements are put together by recursive descent over the control
flow graph: a loop's header opens ``while``, a branch is closed at its
immediate post-dominator, a guarded range becomes ``try``.  Flow that fits none
of these is written as a labelled jump, and the method counts as unstructured.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from cairn.jvm import cfg
from cairn.jvm.bytecode import Insn
from cairn.operators.graph import dominator_sets, immediate, natural_loops
from cairn.sources.managed import ClassFile, Member

#: Binding strength of operators, as in Java.
STRENGTH = {"*": 12, "/": 12, "%": 12, "+": 11, "-": 11, "<<": 10, ">>": 10, ">>>": 10, "<": 9, "<=": 9, ">": 9, ">=": 9, "instanceof": 9, "==": 8, "!=": 8, "&": 7, "^": 6, "|": 5, "&&": 4, "||": 3, "?": 2}
UNARY, ATOM = 13, 16
BINARY = {"add": "+", "sub": "-", "mul": "*", "div": "/", "rem": "%", "shl": "<<", "shr": ">>", "ushr": ">>>", "and": "&", "or": "|", "xor": "^"}
TESTS = {"eq": "==", "ne": "!=", "lt": "<", "ge": ">=", "gt": ">", "le": "<="}
INVERSE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "V": "void", "Z": "boolean"}
ARRAYS = {4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}


class Expr(NamedTuple):
    text: str
    strength: int = ATOM
    kind: str = ""  # its type: a descriptor's first letter, "Z" for conditions
    parts: tuple = ()  # (left, operator, right)

    def inside(self, least: int) -> str:
        return self.text if self.strength >= least else f"({self.text})"


def type_name(descriptor: str) -> str:
    depth = len(descriptor) - len(descriptor.lstrip("["))
    base = descriptor[depth:]
    name = PRIMITIVES.get(base) or base[1:-1].replace("/", ".").replace("$", ".")
    return name.removeprefix("java.lang.") + "[]" * depth


def parameters(descriptor: str) -> tuple[list[str], str]:
    """Parameter descriptors and the result's."""
    inside, _, result = descriptor[1:].partition(")")
    return re.findall(r"\[*(?:L[^;]+;|[BCDFIJSZ])", inside), result


def binary(a: Expr, op: str, b: Expr, kind: str = "") -> Expr:
    s = STRENGTH[op]
    return Expr(f"{a.inside(s)} {op} {b.inside(s + 1)}", s, kind, (a, op, b))


def inverted(e: Expr) -> Expr:
    if e.parts and e.parts[1] in INVERSE:
        a, op, b = e.parts
        return binary(a, INVERSE[op], b, "Z")
    if e.parts and e.parts[1] in ("&&", "||"):
        a, op, b = e.parts
        return binary(inverted(a), "||" if op == "&&" else "&&", inverted(b), "Z")
    if e.text.startswith("!") and e.strength == UNARY:
        return Expr(e.text[1:].removeprefix("(").removesuffix(")") if e.text.startswith("!(") else e.text[1:], ATOM, "Z")
    return Expr(f"!{e.inside(UNARY)}", UNARY, "Z")


class Method:
    def __init__(self, owner: ClassFile, method: Member):
        self.owner, self.method, self.code, self.pool = owner, method, method.code, owner.pool
        self.blocks = cfg.blocks(self.code)
        self.structured, self.declared, self.fresh = True, set(), 0
        self.static = "static" in method.access
        self.names = {}
        slot = 0
        if not self.static:
            self.names[0], slot = "this", 1
        kinds, self.result = parameters(method.descriptor)
        self.params = []
        for n, kind in enumerate(kinds):
            name = self.code.local_name(slot, 0) or f"a{n}"
            self.names[slot] = name
            self.declared.add(name)
            self.params.append(f"{type_name(kind)} {name}")
            slot += 2 if kind in "JD" else 1
        self.types = {x["name"]: x["descriptor"] for x in self.code.locals}

    # ---- one block

    def local(self, slot: int, pc: int) -> str:
        return self.code.local_name(slot, pc) or self.names.get(slot) or f"v{slot}"

    def run(self, start: int, stack: list[Expr]) -> tuple[list[str], Expr | None, list[Expr]]:
        """Statements of a block, its last condition (or switch value), and the stack it leaves."""
        out, condition, stack = [], None, list(stack)
        for i in self.blocks[start].insns:
            condition = self.step(i, stack, out)
        return out, condition, stack

    def pop(self, stack: list[Expr]) -> Expr:
        return stack.pop() if stack else Expr("?")

    def assign(self, name: str, value: Expr, out: list[str], kind: str = ""):
        if value.parts and value.parts[0].text == name and value.parts[1] in BINARY.values():
            op, by = value.parts[1], value.parts[2].text
            out.append(f"{name}{op * 2};" if op in "+-" and by == "1" else f"{name} {op}= {by};")
            return
        if kind and name not in self.declared and "." not in name and "[" not in name:
            self.declared.add(name)
            out.append(f"{kind} {name} = {value.text};")
        else:
            out.append(f"{name} = {value.text};")

    def step(self, i: Insn, stack: list[Expr], out: list[str]) -> Expr | None:
        op, pop, push = i.op, lambda: self.pop(stack), stack.append
        t, rest = op[0], op[1:]
        if op == "aconst_null":
            push(Expr("null"))
        elif re.fullmatch(r"[ilfd]const_(m1|\d)", op):
            n = op.rpartition("_")[2].replace("m1", "-1")
            push(Expr(n + {"l": "L", "f": "f", "d": ".0"}.get(t, ""), UNARY if n[0] == "-" else ATOM, t.upper()))
        elif op in ("bipush", "sipush"):
            push(Expr(str(i.args[0]), UNARY if i.args[0] < 0 else ATOM, "I"))
        elif op in ("ldc", "ldc_w", "ldc2_w"):
            tag = self.pool.tags[i.args[0]]
            value = self.pool.describe(i.args[0]) + {7: ".class", 5: "L", 4: "f"}.get(tag, "")
            push(Expr(value, UNARY if value[0] == "-" else ATOM, "String" if tag == 8 else ""))
        elif m := re.fullmatch(r"([ilfda])(load|store)(?:_(\d))?", op):
            slot = int(m[3]) if m[3] else i.args[0]
            if m[2] == "load":
                name = self.local(slot, i.pc)
                push(Expr(name, ATOM, self.types.get(name, m[1].upper())[:1]))
            else:
                name, value = self.local(slot, i.pc + i.size), pop()
                kind = type_name(self.types[name]) if name in self.types else {"i": "int", "l": "long", "f": "float", "d": "double"}.get(m[1], "Object")
                self.assign(name, value, out, kind)
        elif re.fullmatch(r"[ilfdabcs]aload", op):
            index, array = pop(), pop()
            push(Expr(f"{array.inside(ATOM)}[{index.text}]", ATOM, t.upper()))
        elif re.fullmatch(r"[ilfdabcs]astore", op):
            value, index, array = pop(), pop(), pop()
            self.assign(f"{array.inside(ATOM)}[{index.text}]", value, out)
        elif op in ("pop", "pop2"):
            gone = pop()
            if "(" in gone.text and not gone.text.startswith("("):
                out.append(f"{gone.text};")
        elif op == "dup":
            push(stack[-1] if stack else Expr("?"))
        elif op == "dup2":
            stack.extend(stack[-2:] if stack and stack[-1].kind not in ("J", "D") else stack[-1:])
        elif op.startswith("dup"):
            top = pop()
            at = max(0, len(stack) - (2 if op.endswith("x2") and stack and stack[-1].kind not in ("J", "D") else 1))
            stack.insert(at, top)
            push(top)
        elif op == "swap" and len(stack) > 1:
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif t in "ilfd" and rest in BINARY:
            b, a = pop(), pop()
            push(binary(a, BINARY[rest], b, t.upper()))
        elif t in "ilfd" and rest == "neg":
            push(Expr(f"-{pop().inside(UNARY)}", UNARY, t.upper()))
        elif op == "iinc":
            name, by = self.local(i.args[0], i.pc), i.args[1]
            out.append(f"{name}++;" if by == 1 else f"{name}--;" if by == -1 else f"{name} {'+' if by > 0 else '-'}= {abs(by)};")
        elif m := re.fullmatch(r"[ilfd]2([ilfdbcs])", op):
            push(Expr(f"({PRIMITIVES[{'l': 'J'}.get(m[1], m[1].upper())]}) {pop().inside(UNARY)}", UNARY, {"l": "J"}.get(m[1], m[1].upper())))
        elif "cmp" in op and not op.startswith("if"):
            b, a = pop(), pop()
            push(Expr(f"compare({a.text}, {b.text})", ATOM, "I", (a, "cmp", b)))
        elif m := re.fullmatch(r"if_[ia]cmp(..)", op):
            b, a = pop(), pop()
            return binary(a, TESTS[m[1]], b, "Z")
        elif op in ("ifnull", "ifnonnull"):
            return binary(pop(), "==" if op == "ifnull" else "!=", Expr("null"), "Z")
        elif op.startswith("if"):
            a, test = pop(), TESTS[op[2:]]
            if a.parts and a.parts[1] == "cmp":
                return binary(a.parts[0], test, a.parts[2], "Z")
            if a.kind == "Z" and test in ("==", "!="):
                return inverted(a) if test == "==" else a
            return binary(a, test, Expr("0"), "Z")
        elif op in ("tableswitch", "lookupswitch"):
            return pop()
        elif re.fullmatch(r"[ilfda]return", op):
            value = pop()
            out.append(f"return {({'0': 'false', '1': 'true'}.get(value.text, value.text) if self.result == 'Z' else value.text)};")
        elif op == "return":
            out.append("return;")
        elif op == "athrow":
            out.append(f"throw {pop().text};")
        elif op in ("getstatic", "getfield"):
            owner, name, kind = self.pool.member(i.args[0])
            base = _short(owner, self.owner.name) if op == "getstatic" else pop().inside(ATOM)
            push(Expr(f"{base}.{name}" if base else name, ATOM, kind[:1]))
        elif op in ("putstatic", "putfield"):
            owner, name, _ = self.pool.member(i.args[0])
            value = pop()
            base = _short(owner, self.owner.name) if op == "putstatic" else pop().inside(ATOM)
            self.assign(f"{base}.{name}" if base else name, value, out)
        elif op.startswith("invoke"):
            self.invoke(i, stack, out)
        elif op == "new":
            push(Expr(f"new {_short(self.pool.name(i.args[0]))}", ATOM, "new"))
        elif op in ("newarray", "anewarray"):
            kind = ARRAYS.get(i.args[0], "?") if op == "newarray" else _short(self.pool.name(i.args[0]))
            push(Expr(f"new {kind}[{pop().text}]"))
        elif op == "multianewarray":
            sizes = [pop().text for _ in range(i.args[1])][::-1]
            push(Expr(f"new {type_name(self.pool.name(i.args[0]).replace('.', '/')).rstrip('[]')}" + "".join(f"[{s}]" for s in sizes)))
        elif op == "arraylength":
            push(Expr(f"{pop().inside(ATOM)}.length", ATOM, "I"))
        elif op == "checkcast":
            name = self.pool.name(i.args[0])
            push(Expr(f"({type_name(name.replace('.', '/')) if name.startswith('[') else _short(name)}) {pop().inside(UNARY)}", UNARY))
        elif op == "instanceof":
            push(Expr(f"{pop().inside(9)} instanceof {_short(self.pool.name(i.args[0]))}", 9, "Z"))
        elif op == "monitorenter":
            out.append(f"// synchronized ({pop().text})")
        elif op == "monitorexit":
            pop()
        elif op not in ("nop", "goto", "goto_w"):
            out.append(f"// {op}")
            self.structured = False
        return None

    def invoke(self, i: Insn, stack: list[Expr], out: list[str]):
        if i.op == "invokedynamic":
            boot, pair = self.pool.at(i.args[0], 18)
            name, descriptor = self.pool.pair(pair)
            kinds, result = parameters(descriptor)
            args = [self.pop(stack) for _ in kinds][::-1]
            stack.append(self.concat(boot, args) if name == "makeConcatWithConstants" else Expr(f"{name}({', '.join(a.text for a in args)})", ATOM, result[:1]))
            return
        owner, name, descriptor = self.pool.member(i.args[0])
        kinds, result = parameters(descriptor)
        args = [self.pop(stack) for _ in kinds][::-1]
        given = ", ".join({"0": "false", "1": "true"}.get(a.text, a.text) if k == "Z" else a.text for a, k in zip(args, kinds))
        if i.op == "invokestatic":
            base = _short(owner, self.owner.name)
            call = f"{base}.{name}({given})" if base else f"{name}({given})"
        else:
            target = self.pop(stack)
            if name == "<init>":
                if target.kind == "new":
                    made = Expr(f"{target.text}({given})", ATOM)
                    if stack and stack[-1].kind == "new" and stack[-1].text == target.text:
                        stack[-1] = made
                    else:
                        out.append(f"{made.text};")
                    return
                if given or owner != self.owner.parent:
                    out.append(f"{'super' if owner != self.owner.name else 'this'}({given});")
                return
            base = "super" if i.op == "invokespecial" and owner != self.owner.name and target.text == "this" else target.inside(ATOM)
            call = f"{base}.{name}({given})"
            if owner.endswith(("StringBuilder", "StringBuffer")):
                if name == "append" and base.startswith(("new StringBuilder(", "new StringBuffer(", "\u0001")):
                    before = base[1:] if base[0] == "\u0001" else base.partition("(")[2][:-1]
                    item = args[0].inside(STRENGTH["+"] + 1)
                    stack.append(Expr("\u0001" + (f"{before} + {item}" if before else item), ATOM, "L"))
                    return
                if name == "toString" and base[0] == "\u0001":
                    stack.append(Expr(base[1:], STRENGTH["+"], "String"))
                    return
        call = call.replace("\u0001", "")
        if result == "V":
            out.append(f"{call};")
        else:
            stack.append(Expr(call, ATOM, result[:1]))

    def concat(self, boot: int, args: list[Expr]) -> Expr:
        """A string concatenation from its recipe: \\1 stands for an argument, \\2 for a constant."""
        constants = self.owner.bootstraps[boot][1] if boot < len(self.owner.bootstraps) else []
        recipe = self.pool.text(self.pool.at(constants[0], 8)) if constants else "\1" * len(args)
        items, rest, more = [], iter(args), iter(constants[1:])
        for piece in re.split("([\1\2])", recipe):
            if piece == "\1":
                items.append(next(rest).inside(STRENGTH["+"] + 1))
            elif piece == "\2":
                items.append(self.pool.describe(next(more)))
            elif piece:
                items.append('"' + piece.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"')
        if len(items) == 1 or (items and not any(x[0] == '"' for x in items[:2]) and not any(a.kind == "String" for a in args)):
            items = ['""', *items]
        return Expr(" + ".join(items), STRENGTH["+"], "String")

    # ---- statements

    def lines(self) -> list[str]:
        if not self.blocks:
            return []
        nodes, entry = sorted(self.blocks), min(self.blocks)
        succ = {s: b.succ for s, b in self.blocks.items()}
        every = {s: [*b.succ, *b.handlers] for s, b in self.blocks.items()}
        back = {}
        for n in nodes:
            for s in succ[n]:
                back.setdefault(s, []).append(n)
        back[-1] = [n for n in nodes if not succ[n]]
        doms = dominator_sets([*nodes, -1], back, -1)
        self.join = {n: j for n, j in immediate(doms).items() if j != -1}
        self.loops = {}
        for loop in natural_loops(nodes, every, entry):
            self.loops.setdefault(loop["header"], set()).update(loop["body"])
        self.done, self.tries, self.stacks = set(), set(), {}
        return self.sequence(entry, None, None, [])

    def sequence(self, at: int | None, stop: int | None, loop: tuple | None, stack: list[Expr]) -> list[str]:
        """Statements from a block on, up to ``stop``; ``loop``: header, body and exit of the innermost loop."""
        out, self.left = [], []
        while at is not None and at != stop:
            if loop and at == loop[0] and at in self.done:
                out.append("continue;")
                return out
            if loop and at == loop[2]:
                out.append("break;")
                return out
            guard = next((e for e in self.code.exceptions if e["start"] == at and (e["start"], e["end"], e["handler"]) not in self.tries and e["handler"] in self.blocks), None)
            if guard:
                at, stack = self.guarded(guard, at, stop, loop, stack, out)
                continue
            if at in self.loops and at not in self.done:
                at, stack = self.looped(at, stop, stack, out), []
                continue
            if at in self.done:
                self.structured = False
                out.append(f"// goto L{at}")
                return out
            self.done.add(at)
            body, condition, stack = self.run(at, stack)
            out += body
            block = self.blocks[at]
            last = block.insns[-1].op
            if last in ("tableswitch", "lookupswitch"):
                at, stack = self.switched(at, condition, loop, out, stack), []
            elif condition is not None and len(block.succ) == 2:
                at, stack = self.branched(at, condition, loop, out, stack)
            else:
                at = block.succ[0] if block.succ else None
        self.left = stack
        return out

    def branched(self, at, condition, loop, out, stack):
        """An if with or without else; a value that both sides leave on the stack becomes a conditional expression."""
        fall, jump = self.blocks[at].succ[0], self.blocks[at].insns[-1].targets[0]
        while True:  # short-circuit tests: a next block that is nothing but a test with a shared target
            block = self.blocks[fall]
            if len(block.succ) != 2 or fall in self.done or fall in self.loops or sum(fall in b.succ for b in self.blocks.values()) > 1:
                break
            body, second, left = self.run(fall, stack)
            if body or second is None or len(left) != len(stack) or block.insns[-1].op.endswith("switch"):
                break
            if block.insns[-1].targets[0] == jump:
                condition = binary(condition, "||", second, "Z")
            elif block.succ[0] == jump:
                condition, jump = binary(inverted(condition), "&&", second, "Z"), block.insns[-1].targets[0]
            else:
                break
            self.done.add(fall)
            at, fall = fall, block.succ[0]
        join = self.join.get(at)
        value = self.conditional(fall, jump, join, condition, stack)
        if value is not None:
            return join, value
        if loop and (join is None or join not in loop[1]):
            join = None
        yes = self.sequence(fall, join, loop, list(stack)) if fall != join else []
        no = self.sequence(jump, join, loop, list(stack)) if jump != join else []
        ends = ("return", "throw", "break;", "continue;")
        test = inverted(condition)
        if yes and no and (yes[-1].startswith(ends) or no[-1].startswith(ends)):
            if not yes[-1].startswith(ends):
                yes, no, test = no, yes, condition
            out += [f"if ({test.text}) {{", *indented(yes), "}", *no]
        elif yes:
            out += [f"if ({test.text}) {{", *indented(yes), *(["} else {", *indented(no)] if no else []), "}"]
        elif no:
            out += [f"if ({condition.text}) {{", *indented(no), "}"]
        return join, stack

    def conditional(self, fall, jump, join, condition, stack):
        if join is None or any(s not in self.blocks or self.blocks[s].succ != [join] or s in self.done for s in (fall, jump)):
            return None
        (a, _, left), (b, _, right) = self.run(fall, stack), self.run(jump, stack)
        if a or b or len(left) != len(stack) + 1 or len(right) != len(left):
            return None
        self.done.update((fall, jump))
        if {left[-1].text, right[-1].text} == {"0", "1"}:
            return [*stack, (inverted(condition) if left[-1].text == "1" else condition)]
        return [*stack, Expr(f"{inverted(condition).inside(3)} ? {left[-1].inside(3)} : {right[-1].inside(2)}", 2, left[-1].kind)]

    def looped(self, head, stop, stack, out):
        body = self.loops[head]
        exits = sorted({s for n in body for s in self.blocks[n].succ if s not in body})
        self.done.add(head)
        first, condition, _ = self.run(head, stack)
        block = self.blocks[head]
        outside = [s for s in block.succ if s not in body]
        if condition is not None and not first and len(block.succ) == 2 and len(outside) == 1:
            leave = outside[0]
            inner = next(s for s in block.succ if s in body)
            test = condition if block.insns[-1].targets[0] == inner else inverted(condition)
            out += [f"while ({test.text}) {{", *indented(_trimmed(self.sequence(inner, None, (head, body, leave), []) if inner != head else [])), "}"]
            return leave
        leave = exits[0] if len(exits) == 1 else next((e for e in exits if e == self.join.get(head)), exits[-1] if exits else None)
        rest = (head, body, leave)
        if condition is not None and len(block.succ) == 2:
            at, left = self.branched(head, condition, rest, first, [])
            first += self.sequence(at, None, rest, left) if at is not None else []
        elif block.succ and block.succ[0] != head:
            first += self.sequence(block.succ[0], None, rest, [])
        out += ["while (true) {", *indented(_trimmed(first)), "}"]
        return leave

    def switched(self, at, value, loop, out, stack):
        last = self.blocks[at].insns[-1]
        join = self.join.get(at)
        cases = {}
        for key, target in zip(last.keys, last.targets[1:]):
            cases.setdefault(target, []).append(str(key))
        out.append(f"switch ({value.text}) {{")
        order = sorted({*cases, last.targets[0]})
        for target in order:
            labels = [f"case {k}:" for k in cases.get(target, [])] + (["default:"] if target == last.targets[0] else [])
            if target == join and labels == ["default:"]:
                continue
            body = self.sequence(target, join, loop, list(stack)) if target != join and target not in self.done else []
            if not (body and body[-1].startswith(("return", "throw", "continue;"))):
                body = [*body, "break;"]
            out += [*("  " + x for x in labels), *indented(indented(body))]
        out.append("}")
        return join

    def guarded(self, guard, at, stop, loop, stack, out):
        same = [e for e in self.code.exceptions if (e["start"], e["end"]) == (guard["start"], guard["end"])]
        self.tries.update((e["start"], e["end"], e["handler"]) for e in same)
        after = self.after(guard)
        body = self.sequence(at, after if after is not None else stop, loop, stack)
        left = self.left
        if left and after is not None and self.blocks[after].insns[0].op.endswith("return"):
            body.append(f"return {left[-1].text};")  # the value of the guarded code is what is returned behind it
            self.done.add(after)
            after, left = None, []
        out += ["try {", *indented(body)]
        for e in same:
            if e["handler"] in self.done:
                continue
            self.fresh += 1
            caught, handler = f"e{self.fresh}", self.blocks[e["handler"]]
            first = handler.insns[0]
            if first.op.startswith("astore"):
                slot = int(first.op[-1]) if "_" in first.op else first.args[0]
                caught = self.local(slot, first.pc + first.size)
                self.declared.add(caught)
            inner = self.sequence(e["handler"], after if after is not None else stop, loop, [Expr(caught)])
            inner = [x for x in inner if x not in (f"{caught} = {caught};",)]
            out += [f"}} catch ({_short(e['type']) if e['type'] else 'Throwable'} {caught}) {{", *indented(inner)]
        out.append("}")
        return (after if after is not None else stop), left

    def after(self, guard):
        """Where a guarded range goes on to: the first place that leaves it and is no handler."""
        handlers = {e["handler"] for e in self.code.exceptions}
        inside = [b for s, b in self.blocks.items() if guard["start"] <= s < guard["end"]]
        leaves = sorted({s for b in inside for s in b.succ if not guard["start"] <= s < guard["end"] and s not in handlers})
        for s in leaves:  # the compiler guards up to the jump: look through it
            block = self.blocks[s]
            if len(block.insns) == 1 and block.insns[0].op.startswith("goto") and s == guard["end"]:
                return block.succ[0]
        return leaves[0] if leaves else None


def _short(name: str, own: str | None = None) -> str:
    return "" if name == own else name.removeprefix("java.lang.").replace("$", ".")


def _trimmed(lines: list[str]) -> list[str]:
    return lines[:-1] if lines and lines[-1] == "continue;" else lines


def indented(lines: list[str]) -> list[str]:
    return ["  " + x for x in lines]


def method_text(owner: ClassFile, method: Member) -> tuple[str, bool]:
    """The whole method, and whether all of its flow became statements."""
    m = Method(owner, method)
    lines = _trimmed(m.lines())
    if lines and lines[-1] == "return;":
        lines.pop()
    name = owner.name.rpartition(".")[2] if method.name == "<init>" else "static" if method.name == "<clinit>" else method.name
    head = " ".join([*(a for a in method.access if a not in ("bridge", "varargs", "synthetic")), *([] if method.name in ("<init>", "<clinit>") else [type_name(m.result)]), f"{name}({', '.join(m.params)})"])
    throws = f" throws {', '.join(map(_short, method.throws))}" if method.throws else ""
    return "\n".join([f"{head}{throws} {{", *indented(lines), "}"]).replace("\u0001", ""), m.structured
