"""Methods of class files as tables: listing, control flow and decompiled text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cairn.jvm import bytecode, cfg, decompile
from cairn.sources import managed
from cairn.sources.tables import _table, class_entries


def instructions(found: DataFrame) -> DataFrame:
    """One row per instruction, with the line it belongs to."""

    def parse(sha, data):
        for _, body in class_entries(data):
            c = managed.parse_class(body)
            for m in c.methods:
                if m.code:
                    for i in bytecode.decode(m.code.code)[0]:
                        yield sha, c.name, m.name, m.descriptor, i.pc, i.op, bytecode.text(i, c.pool), list(i.targets), m.code.line_for(i.pc)

    return _table(found, parse, "sha256 string, owner string, method string, descriptor string, pc int, op string, text string, targets array<int>, line int")


def control_flow(found: DataFrame) -> DataFrame:
    """One row per method: sizes of its graph, complexity and loops."""

    def parse(sha, data):
        for _, body in class_entries(data):
            c = managed.parse_class(body)
            for m in c.methods:
                if m.code:
                    s = cfg.summary(m.code)
                    yield sha, c.name, m.name, m.descriptor, s["blocks"], s["edges"], s["complexity"], len(s["loops"]), s["max_depth"], s["exits"]

    return _table(found, parse, "sha256 string, owner string, method string, descriptor string, blocks int, edges int, complexity int, loops int, max_depth int, exits int")


def decompiled(found: DataFrame) -> DataFrame:
    """One row per method: Java-like text and whether all of its flow could be put into statements."""

    def parse(sha, data):
        for _, body in class_entries(data):
            c = managed.parse_class(body)
            for m in c.methods:
                if m.code:
                    text, structured = decompile.method_text(c, m)
                    yield sha, c.name, m.name, m.descriptor, text, structured

    return _table(found, parse, "sha256 string, owner string, method string, descriptor string, text string, structured boolean")
