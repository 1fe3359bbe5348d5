"""Basic blocks and control flow of one method."""

from __future__ import annotations

from dataclasses import dataclass, field

from cairn.jvm.bytecode import ENDS, Insn, decode
from cairn.operators.graph import dominator_sets, immediate, natural_loops
from cairn.sources.managed import Code


@dataclass
class Block:
    start: int
    end: int
    insns: list[Insn]
    succ: list[int] = field(default_factory=list)
    handlers: list[int] = field(default_factory=list)


def blocks(code: Code) -> dict[int, Block]:
    """Blocks by their first place; exception edges go from every block that starts in a guarded range."""
    insns, _ = decode(code.code)
    if not insns:
        return {}
    places = {i.pc for i in insns}
    lead = {insns[0].pc}
    for i in insns:
        lead.update(t for t in i.targets if t in places)
        if (i.targets or i.op in ENDS) and i.pc + i.size in places:
            lead.add(i.pc + i.size)
    for e in code.exceptions:
        lead.update(p for p in (e["start"], e["end"], e["handler"]) if p in places)
    out = {}
    for i in insns:
        if i.pc in lead:
            now = out[i.pc] = Block(i.pc, i.pc, [])
        now.insns.append(i)
        now.end = i.pc + i.size
    for b in out.values():
        last = b.insns[-1]
        go = [t for t in last.targets if t in out]
        if last.op not in ENDS and b.end in out:
            go = [b.end, *go]
        b.succ = list(dict.fromkeys(go))
        b.handlers = list(dict.fromkeys(e["handler"] for e in code.exceptions if e["start"] <= b.start < e["end"] and e["handler"] in out))
    return out


def summary(code: Code) -> dict:
    """Counts, complexity, loops and exits of a method."""
    found = blocks(code)
    if not found:
        return {"blocks": 0, "edges": 0, "complexity": 0, "loops": [], "exits": 0, "max_depth": 0, "idom": {}}
    succ = {s: [*b.succ, *b.handlers] for s, b in found.items()}
    entry = min(found)
    edges = sum(len(set(x)) for x in succ.values())
    loops = natural_loops(sorted(found), succ, entry)
    exits = sum(not b.succ for b in found.values())
    return {
        "blocks": len(found),
        "edges": edges,
        "complexity": edges - len(found) + 2,
        "loops": loops,
        "exits": exits,
        "max_depth": max((x["depth"] for x in loops), default=0),
        "idom": immediate(dominator_sets(sorted(found), succ, entry)),
    }
