import re

from cairn.llm import licenses


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), found


def test_rules_are_many_and_ordered():
    table = licenses.rules()
    assert len(table) > 600 and len(licenses.OWN) > 80 and [r.priority for r in table] == sorted((r.priority for r in table), reverse=True)
    for r in table:
        re.compile(r.expression)


def test_base_places_against_brute_force(docs, empty):
    rows = {(r.doc_id, r.n_words): r for r in licenses.digest(licenses.scan(docs)).collect()}
    for d in docs.collect():
        n, found = plain(d.text)
        r = rows[d.doc_id, n]
        assert r.n_base == len(found)
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.digest(licenses.scan(empty)).count() == 0


def labels(spark, *texts):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.labels for r in licenses.digest(licenses.scan(table)).orderBy("doc_id").collect()]


def test_labels_and_suppression(spark):
    got = labels(
        spark,
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "This is free software under the GNU GPL.",
        "you are permitted to limit the permit",
        "licensed under CC BY-NC-SA 4.0",
        "under the MIT license under the MIT license",
        "dual licensed under the Apache License Version 2.0 and also under the MIT License",
    )
    assert got == ["gpl-3", "bsd-3", "gpl", "", "cc-by-nc,cc-by-nc-sa", "mit", "apache-2,mit"]


def test_containment_against_brute_force(spark):
    texts = ["licensed under the terms of the apache license version 2 0 all rights reserved licensed under the mozilla public license 2 0 see license"] * 2 + ["mit license bsd license isc license under the mit license"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(table).collect():
        all_spans = [(s.start, -s.minus_end, -s.minus_priority, s.label) for s in r.spans]
        kept = sorted((s.start, -s.minus_end, -s.minus_priority, s.label) for s in r.kept)

        def hidden(d):
            return d[2] != licenses.BASE_PRIORITY and any(e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[0], e[1]) != d[:2]) for e in all_spans)

        assert kept == sorted(s for s in all_spans if not hidden(s))


def test_no_python_on_the_executors(docs):
    plan = licenses.digest(licenses.scan(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("InMemory")[0]


def test_many_places_in_a_long_text(spark):
    table = spark.createDataFrame([(1, "filler words here. Released under the MIT License. " * 2000)], "doc_id long, text string")
    r = licenses.digest(licenses.scan(table)).first()
    assert (r.n_base, r.first_word, r.last_word, r.n_words) == (2000, 4, 4 + 8 * 1999, 16_000)


def test_every_match_has_a_keyword_of_its_rule():
    from re import _parser

    def texts(items, optional):
        out = [""]
        for op, arg in items:
            if op is _parser.LITERAL:
                found = [chr(arg)]
            elif op is _parser.IN:
                found = [chr(arg[0][1] if arg[0][0] is _parser.LITERAL else arg[0][1][0])]
            elif op is _parser.SUBPATTERN:
                found = texts(arg[3], optional)
            elif op is _parser.BRANCH:
                found = [t for branch in arg[1] for t in texts(branch, optional)]
            else:
                assert op is _parser.MAX_REPEAT, op
                found = texts(arg[2], optional) if arg[0] or optional else [""]
            out = [a + b for a in out for b in found]
        return out

    for r in licenses.rules():
        for optional in (False, True):
            for text in texts(_parser.parse(r.expression), optional):
                assert re.fullmatch(r.expression, text), (r, text)
                assert r.keywords and all(any(k in f" {text} " for k in found) for found in r.keywords), (r, text, r.keywords)
                assert any(g in f" {text} " for g in licenses.GATE), (r, text)


def test_identifiers_and_long_names_alone(spark):
    got = labels(
        spark,
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the European Union Public Licence",
        "under the do what the fuck you want to public license",
    )
    assert got == ["gpl-2", "mpl-2", "eupl-1", "wtfpl"]


def test_gated_scan_equals_the_ungated_one(spark):
    """Every alternative of every rule as a text of its own: gates hide no match."""
    from re import _parser

    def texts(items):
        out = [""]
        for op, arg in items:
            if op is _parser.LITERAL:
                found = [chr(arg)]
            elif op is _parser.IN:
                found = [chr(arg[-1][1] if arg[-1][0] is _parser.LITERAL else arg[-1][1][1])]
            elif op is _parser.SUBPATTERN:
                found = texts(arg[3])
            elif op is _parser.BRANCH:
                found = [t for branch in arg[1] for t in texts(branch)]
            else:
                found = texts(arg[2])[:1] + ([""] if not arg[0] else [])
            out = [a + b for a in out[:40] for b in found[:12]]
        return out

    made = sorted({t for r in licenses.rules() for t in texts(_parser.parse(r.expression))[:12]})
    table = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.id: sorted(tuple(s) for s in r.spans) for r in licenses.scan(table.repartition(8)).collect()}
    found = [(r, re.compile(f"(?<= )({r.expression})(?= )")) for r in licenses.rules()]
    for i, text in list(enumerate(made))[:: max(1, len(made) // 700)]:
        words = f" {text} "
        want = sorted((words[: m.start()].count(" ") - 1, -(words[: m.end()].count(" ") - 1), -r.priority, r.label, r.weight) for r, p in found for m in p.finditer(words))
        assert got[i] == want, text
