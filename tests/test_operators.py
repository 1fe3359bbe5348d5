import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.cache import Cache, Snapshots
from cairn.functions import arity, hex_text, jaccard, ngrams, parse_address, sniff
from cairn.operators import addresses, catalog, graph, grouping, linkage, matching, policy, similarity, text
from cairn.operators.asof import asof_join, extents
from cairn.result import Envelope, PolicyError, guarded, limited

# ---- as-of and addresses


@pytest.mark.parametrize("width", [None, 10])
def test_asof_against_brute_force(spark, width):
    rng = random.Random(4)
    left = [(rng.choice("ab"), rng.choice([None, *range(60)]), i) for i in range(200)]
    right = [(rng.choice("ab"), rng.choice([None, *range(0, 60, 3)]), i) for i in range(40)]
    got = asof_join(spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, v long"), ["k"], "t", ["v"], width).collect()
    assert len(got) == 200
    for r in got:
        best = max(((t, v) for k, t, v in right if k == r.k and t is not None and r.t is not None and t <= r.t), default=(None, None))
        assert r.v == best[1]


def test_locate_asks_the_nearest_start_only(spark):
    sections = spark.createDataFrame([("i", 0, 100, 400, "long"), ("i", 1, 200, 210, "inner"), ("i", 2, 500, 500, "empty"), ("i", 3, 600, 650, "first"), ("i", 4, 600, 620, "second")], "img string, ord long, start long, end long, name string")
    points = spark.createDataFrame([("i", p) for p in (50, 100, 205, 250, 500, 610, 630)], "img string, p long")
    got = {r.p: r.name for r in addresses.locate(points, sections, ["img"], "p", "start", "end", ["name"], "ord").collect()}
    assert got == {50: None, 100: "long", 205: "inner", 250: None, 500: None, 610: "second", 630: None}


def test_virtual_tail_has_no_file_bytes(spark):
    sections = spark.createDataFrame([("i", "bss", 0x1000, 0x100, 0x200, 0x40)], "img string, name string, va long, vsize long, fileoff long, filesize long")
    points = spark.createDataFrame([("i", 0x1000), ("i", 0x103F), ("i", 0x1040), ("i", 0x2000)], "img string, va long")
    got = {int(r.va): r.offset for r in addresses.va_to_offset(points, sections, ["img"]).collect()}
    assert got == {0x1000: 0x200, 0x103F: 0x23F, 0x1040: None, 0x2000: None}
    back = spark.createDataFrame([("i", 0x23F), ("i", 0x240)], "img string, offset long")
    assert {r.offset: r.va and int(r.va) for r in addresses.offset_to_va(back, sections, ["img"]).collect()} == {0x23F: 0x103F, 0x240: None}


def test_address_literals(spark):
    texts = {"0x1F": 31, " 0X1f ": 31, "1_000": 1000, "ff": 255, "0b101": 5, "0o17": 15, "-0x10": -16, "12": 12, "zz": None, "": None, "0xffffffffffffffff": (1 << 64) - 1}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_address(F.col("t")).alias("v")).collect()
    assert {r.t: None if r.v is None else int(r.v) for r in rows} == texts
    assert spark.range(1).select(hex_text(F.lit("18446744073709551615").cast("decimal(20,0)"))).first()[0] == "0x" + "f" * 16


def test_extents(spark):
    rows = spark.createDataFrame([("a", 10), ("a", 30), ("a", 5000), ("b", 7)], "k string, s long")
    assert sorted(tuple(r) for r in extents(rows, ["k"], "s", 100).collect()) == [("a", 10, 30), ("a", 30, 130), ("a", 5000, 5100), ("b", 7, 107)]


# ---- groups and text


def test_capped_groups_count_what_they_leave_out(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(7 if k else 2)], "k string, i long")
    got = grouping.capped(rows, ["k"], ["i"], 3).collect()
    assert sorted((r.k or "", r.i, r.seq, r.total, r.overflow) for r in got) == [("", 0, 1, 2, 0), ("", 1, 2, 2, 0), ("a", 0, 1, 7, 4), ("a", 1, 2, 7, 4), ("a", 2, 3, 7, 4)]


def test_duplicates_need_two_sources(spark):
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a"), ("y", "b"), ("y", "b")], "name string, source string")
    assert [tuple(r) for r in grouping.duplicates(rows, "name", "source").collect()] == [("y", 3, ["a", "b"])]


def test_ngrams_and_entropy(spark):
    rows = spark.createDataFrame([("a b c d",), ("a b",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(ngrams(text.words(F.col("t")), 3)).collect()]
    assert got == [["a b c", "b c d"], [], [], None] or got == [["a b c", "b c d"], [], [], []]
    values = spark.createDataFrame([(1, "aabb"), (2, "abcd"), (3, "aaaa"), (4, ""), (5, None)], "k long, t string")
    assert {r.k: r.entropy for r in text.character_entropy(values, "k", "t").collect()} == {1: 1.0, 2: 2.0, 3: 0.0, 4: None, 5: None}


def test_bad_patterns_filter_nothing_and_warn(spark):
    rows = spark.createDataFrame([("License",), ("other",)], "t string")
    got, warnings = text.matching(rows, "t", "LICEN[CS]E")
    assert got.count() == 1 and not warnings
    got, warnings = text.matching(rows, "t", "([")
    assert got.count() == 2 and warnings[0]["code"] == "bad_pattern"


def test_sniff_as_a_column(spark):
    rows = spark.createDataFrame([(bytearray(b"\x7fELF1234"),), (bytearray(b"MZ" + bytes(90)),), (bytearray(b"PK\3\4zz"),), (bytearray(b"ab"),)], "b binary")
    assert [r[0] for r in rows.select(sniff(F.col("b"))).collect()] == ["elf", "dos_mz", "zip", "unknown"]


# ---- similarity


def test_abstaining_signals(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a"], ["a"]), (["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(jaccard(F.col("x"), F.col("y"))).collect()] == [None, 0.0, 1.0, 1 / 3]
    parts = {"strings": F.lit(1.0), "imports": F.lit(None).cast("double"), "ngrams": F.lit(0.5)}
    got = spark.range(1).select(similarity.weighted(parts), similarity.agreeing(parts), similarity.abstained(parts)).first()
    assert got[0] == round((0.3 + 0.1) / 0.5, 4) and got[1] == 2 and got[2] == ["imports"]
    nothing = {"strings": F.lit(None).cast("double")}
    assert spark.range(1).select(similarity.weighted(nothing)).first()[0] is None


def features(spark, rows):
    return spark.createDataFrame(rows, "key string, strings array<string>, imports array<string>, constants array<long>, ngrams array<string>, signature string, size long, calls long, branches long, returns long")


def test_matching_ranks_and_counts_ambiguity(spark):
    a = features(spark, [("f", ["s1", "s2"], ["i1"], [70000], ["g1", "g2"], "90c3", 10, 1, 2, 1), ("g", [], [], [], ["zz"], "90", 3, 0, 0, 1)])
    b = features(spark, [("f1", ["s1", "s2"], ["i1"], [70000], ["g1", "g2"], "90c3", 10, 1, 2, 1), ("f2", ["s1", "s2"], ["i1"], [70000], ["g1", "g9"], "90??", 11, 1, 2, 1), ("h", ["other"], [], [], [], "", 1, 0, 0, 0)])
    got = matching.match(a, b).collect()
    assert [(r.a, r.b, r.rank) for r in got] == [("f", "f1", 1), ("f", "f2", 2)] and got[0].score == 1.0 and got[0].abstained == []
    assert tuple(matching.ambiguity(matching.match(a, b), a).first()) == (1, 1, 0, 1)


# ---- graphs


def brute_dominators(nodes, succ, entry):
    def reached(banned):
        seen, work = set(), [entry] if entry != banned else []
        while work:
            n = work.pop()
            if n not in seen and n != banned:
                seen.add(n)
                work += succ.get(n, ())
        return seen

    every = reached(None)
    return {n: {d for d in every if n not in reached(d) or d == n} if n in every else {n} for n in nodes}


def test_dominators_and_loops_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        nodes = list(range(8))
        succ = {n: sorted({rng.randrange(8) for _ in range(rng.randrange(3))}) for n in nodes}
        doms = graph.dominator_sets(nodes, succ, 0)
        assert doms == brute_dominators(nodes, succ, 0)
        back = {(t, h) for t in nodes for h in succ[t] if h in doms[t]}
        found = graph.natural_loops(nodes, succ, 0)
        assert {(x["tail"], x["header"]) for x in found} == back
        for x in found:
            assert x["header"] in x["body"] and x["tail"] in x["body"] and not set(x["exits"]) & set(x["body"])


def test_graph_tables(spark):
    rows = [("m", 0, 1), ("m", 1, 2), ("m", 2, 1), ("m", 1, 3), ("m", 3, None), ("n", 5, 5)]
    edges = spark.createDataFrame([(g, s, d, 0 if g == "m" else 5) for g, s, d in rows], "g string, src long, dst long, entry long")
    got = {(r.g, r.node): (r.dominators, r.idom) for r in graph.dominators(edges, "g").collect()}
    assert got["m", 3] == ([0, 1, 3], 1) and got["m", 0] == ([0], None) and got["n", 5] == ([5], None)
    post = {(r.g, r.node): r.idom for r in graph.post_dominators(edges, "g").collect()}
    assert post["m", 0] == 1 and post["m", 2] == 1 and post["m", 1] == 3 and post["m", 3] is None
    loops = {r.g: (r.header, r.tail, r.body, r.exits) for r in graph.loops(edges, "g").collect()}
    assert loops == {"m": (1, 2, [1, 2], [3]), "n": (5, 5, [5], [])}


def test_bounded_search_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    focus = spark.createDataFrame([(1,)], "origin long")
    got = {(r.direction, r.level, r.node) for r in graph.neighbourhood(edges, focus, 2).collect()}
    assert got == {("callees", 1, 2), ("callees", 2, 3), ("callers", 1, 3), ("callers", 2, 2)}
    assert {r.node: r.level for r in graph.reach(edges, focus, None).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node: (r.callees, r.callers) for r in graph.degrees(edges).collect()}[4] == (0, 1)


# ---- catalogue and policy


def test_verdicts_need_discriminators(spark):
    hit = spark.createDataFrame([("A", "x", True), ("A", "y", False), ("B", "x", False), ("B", "y", False), ("C", "z", False)], "name string, label string, is_discriminator boolean")
    dims = spark.createDataFrame([("A", 2, 1), ("B", 2, 1), ("C", 2, 0)], "name string, min_distinct int, discriminators int")
    assert {r.name: (r.verdict, r.reason) for r in catalog.verdicts(hit, dims).collect()} == {"A": ("identified", ""), "B": ("lead", "no_discriminator"), "C": ("lead", "too_few")}
    marks = spark.createDataFrame([("k", 0x6A09E667, 32), ("small", 0x1000, 32)], "label string, value long, width int")
    assert {r.order: r.pattern for r in catalog.encodings(marks).collect()} == {"big": "6a09e667", "little": "67e6096a", "little64": "67e6096a00000000"}


CLAIM = "confidence double, provenance array<string>, evidence array<struct<kind:string,artifact:string>>"


@pytest.mark.parametrize(
    "claim, violations",
    [
        ((0.3, ["string_xref"], []), []),
        ((0.6, ["string_xref", "import_xref"], []), ["above_cap"]),
        ((0.6, ["symbol_table"], []), ["needs_corroboration"]),
        ((0.9, ["symbol_table", "string_xref"], []), []),
        ((1.5, ["symbol_table", "string_xref"], []), ["confidence_out_of_range", "above_cap"]),
        ((-0.1, ["string_xref"], []), ["confidence_out_of_range"]),
        ((None, ["string_xref"], []), ["confidence_not_numeric"]),
        ((0.1, [], []), ["no_provenance"]),
        ((0.1, ["guess", "structural_guess"], []), ["unknown_class"]),
        ((0.5, ["dynamic_trace", "string_xref"], [("dynamic_trace", "t.bin")]), []),
        ((0.5, ["dynamic_trace", "string_xref"], [("dynamic_trace", " ")]), ["artifact_missing"]),
        ((0.1, ["string_xref"], [(None, "x")]), ["evidence_without_kind"]),
    ],
)
def test_policy_rules(spark, claim, violations):
    got = policy.evaluate(spark.createDataFrame([claim], CLAIM)).first()
    assert got.violations == violations and got.accepted == (not violations)


def test_policy_verification_and_document(spark):
    claims = spark.createDataFrame([(0.3, ["string_xref"], [], ["string_xref"]), (0.3, ["string_xref"], [], [])], CLAIM + ", ok array<string>")
    assert [r.violations for r in policy.evaluate(claims, "ok").collect()] == [[], ["not_verified"]]
    assert policy.document(spark).count() == 12
    known = spark.createDataFrame([("b1", "aa")], "build_id string, sha256 string")
    kept, rejected = policy.register_builds(known, spark.createDataFrame([("b1", "bb"), ("b1", "aa"), ("b2", "cc")], "build_id string, sha256 string"))
    assert kept.count() == 2 and [tuple(r) for r in rejected.collect()] == [("b1", "bb")]


def test_revisions_and_history(spark):
    saves = spark.createDataFrame([("s", 1, 0.3, "a"), ("s", 2, 0.9, "b"), ("s", 3, 0.5, "c"), ("t", 1, 0.1, "d")], "name string, at long, confidence double, note string")
    got = {r.name: (r.note, r.revisions, r.previous_confidence, r.downgraded) for r in policy.revisions(saves, ["name"], ["at"]).collect()}
    assert got == {"s": ("c", 2, 0.9, True), "t": ("d", 0, None, False)}
    assert [[h.note for h in r.history] for r in policy.history(saves, ["name"], ["at"]).collect()] == [["a", "b"]]


# ---- linkage


@pytest.fixture(scope="module")
def program(spark):
    classes = [("p.Host", "java.lang.Object", "host", ["abstract"], 0), ("p.Base", "java.lang.Object", "host", [], 1), ("q.Plug", "p.Base", "own", [], 2), ("q.Odd", "x.Gone", "own", [], 3)]
    interfaces = [("q.Plug", "p.Host")]
    members = [
        ("p.Host", "method", "start", "()V", True, False, False),
        ("p.Host", "method", "stop", "()V", True, False, False),
        ("p.Base", "method", "<init>", "()V", False, False, True),
        ("p.Base", "method", "size", "(I)V", False, False, True),
        ("q.Plug", "method", "<init>", "()V", False, False, True),
        ("q.Plug", "method", "start", "()V", False, False, True),
        ("q.Plug", "method", "size", "(J)V", False, False, True),
    ]
    needs = [
        ("class", "x.Gone", None, None, "q.Odd", 0),
        ("class", "x.Gone", None, None, "q.Plug", 1),
        ("class", "[I", None, None, "q.Plug", 2),
        ("class", "java.util.List", None, None, "q.Plug", 3),
        ("method", "q.Plug", "size", "(I)V", "q.Plug", 4),
        ("method", "q.Plug", "hashCode", "()I", "q.Plug", 5),
        ("method", "q.Plug", "absent", "()V", "q.Plug", 6),
        ("method", "q.Odd", "absent", "()V", "q.Plug", 7),
    ]
    return (
        spark.createDataFrame(classes, "name string, parent string, source string, access array<string>, seq long"),
        spark.createDataFrame(interfaces, "name string, parent string"),
        spark.createDataFrame(members, "owner string, kind string, name string, descriptor string, is_abstract boolean, is_static boolean, has_code boolean"),
        spark.createDataFrame(needs, "kind string, owner string, name string, descriptor string, from_class string, seq long"),
    )


def test_missing_classes_and_members(program):
    classes, interfaces, members, needs = program
    assert [tuple(r) for r in linkage.missing_owners(needs, classes).collect()] == [("x.Gone", "q.Odd", 2)]
    resolved = linkage.resolve_members(needs, classes, interfaces, members)
    assert {(r.owner, r.name): r.outcome for r in resolved.collect()} == {("q.Plug", "size"): "found", ("q.Plug", "hashCode"): "found", ("q.Plug", "absent"): "missing", ("q.Odd", "absent"): "unchecked"}
    loose = linkage.resolve_members(needs, classes, interfaces, members, strict=False)
    assert {r.outcome for r in loose.where("name = 'absent'").collect()} == {"unchecked"}
    assert linkage.scorecard(needs, classes, resolved).first().asDict() == {"distinct_references": 7, "platform_references": 1, "resolved": 2, "unchecked": 1, "missing_members": 1, "missing_classes": 1}


def test_type_health(program):
    classes, interfaces, members, _ = program
    assert [tuple(r) for r in linkage.unimplemented(classes, interfaces, members).collect()] == [("q.Plug", "stop", "()V", "p.Host")]
    assert [tuple(r) for r in linkage.broken_overrides(classes, interfaces, members).collect()] == [("q.Plug", "size", "(J)V", ["p.Base.size(I)V"])]


def test_entrypoints_and_precedence(spark, program):
    classes, _, members, _ = program
    wanted = spark.createDataFrame([("q.Plug",), ("q.Plagg",), ("p.Host",), ("z.Plug",)], "entrypoint string")
    got = {r.entrypoint: (r.problems, r.near, r.ok) for r in linkage.entrypoints(wanted, classes, members).collect()}
    assert got == {"q.Plug": ([], [], True), "q.Plagg": (["missing"], [], False), "p.Host": (["abstract", "no_constructor"], [], False), "z.Plug": (["missing"], ["q.Plug"], False)}
    own = classes.where("source = 'own'")
    both = linkage.universe(own, classes.withColumn("source", F.lit("lib")))
    assert {r.name: r.source for r in both.collect()} == {"p.Host": "lib", "p.Base": "lib", "q.Plug": "own", "q.Odd": "own"}


def test_arity_and_data_references(spark, program):
    rows = spark.createDataFrame([("(IJ[Ljava/lang/String;[[D)V",), ("()V",), ("I",)], "d string")
    assert [r[0] for r in rows.select(arity(F.col("d"))).collect()] == [4, 0, -1]
    refs = spark.createDataFrame([("q.Lost", "f1"), ("q.Lost", "f2"), ("z.Other", "f1"), ("q.Plug", "f1")], "class string, file string")
    got = {r["class"]: (r.files, r.kind) for r in linkage.data_references(refs, program[0]).collect()}
    assert got == {"q.Lost": (2, "missing"), "z.Other": (1, "unresolved_external")}


# ---- results and caches


def test_envelope_and_guard(spark):
    e = Envelope([{"i": i} for i in range(100)])
    assert e.reliability == "sound" and e.warn("refs_clipped", "x").reliability == "degraded" and e.warn("packed", "y", "unreliable").reliability == "unreliable"
    import json

    small = json.loads(e.to_json(600))
    assert 0 < len(small["result"]) < 100 and small["warnings"][-1]["code"] == "response_clipped" and len(e.to_json(600)) <= 600
    got = limited(spark.range(10), 3)
    assert len(got.result) == 3 and got.warnings[0]["detail"] == "3 of 10 rows"

    @guarded
    def fails(error):
        raise error

    assert fails(PolicyError("no", rule=1)) == {"error": "policy_error", "message": "no", "context": {"rule": 1}}
    assert [fails(x)["error"] for x in (KeyError("x"), MemoryError(), KeyboardInterrupt())] == ["internal_error", "out_of_memory", "aborted"]
    with pytest.raises(ValueError):
        e.warn("x", "y", "fine")


def test_cache_hits_misses_and_damage(spark, tmp_path):
    cache, built = Cache(spark, f"file://{tmp_path}/cache"), []

    def build():
        built.append(1)
        return spark.range(5).toDF("v")

    assert [cache.get_or_build("ab" * 32, "index", {"packed": p}, build)[1] for p in (False, False, True)] == [False, True, False]
    assert len(built) == 2 and cache.stats()["entries"] == 2
    for f in (tmp_path / "cache").glob("*.index.*/part-*"):
        f.write_bytes(b"damage")
    spark.catalog.clearCache()
    got, hit = cache.get_or_build("ab" * 32, "index", {"packed": False}, build)
    assert not hit and got.count() == 5
    assert cache.clear("cd" * 32) == 0 and cache.clear("ab" * 32) == 2 and cache.entries() == []


def test_snapshots_keep_generations(spark, tmp_path):
    kb = Snapshots(spark, f"file://{tmp_path}/kb", keep=2)
    assert kb.read() is None
    for n in range(1, 5):
        assert kb.save(spark.range(n).toDF("v")) == n
    assert kb.read().count() == 4 and sorted(p.name for p in (tmp_path / "kb").glob("v=*")) == ["v=2", "v=3", "v=4"] or sorted(p.name for p in (tmp_path / "kb").glob("v=*")) == ["v=3", "v=4"]
    assert math.isfinite(kb.version())


# ---- keys without a value, repeated rows, overridden definitions


@pytest.mark.parametrize("width", [None, 10])
def test_null_keys_never_match(spark, width):
    left = spark.createDataFrame([(None, 30, 1), ("a", 30, 2)], "k string, t long, id long")
    right = spark.createDataFrame([(None, 3, 30), ("a", 3, 40)], "k string, t long, v long")
    assert {r.id: r.v for r in asof_join(left, right, ["k"], "t", ["v"], width).collect()} == {1: None, 2: 40}


@pytest.mark.parametrize("width", [None, 7.0])
def test_verify_site_against_brute_force(spark, width):
    rng = random.Random(9)
    claims = [(rng.choice("ab"), low, low + rng.randint(0, 9)) for low in rng.choices(range(80), k=60)] * 2  # repeated rows stay
    sites = [(rng.choice("abc"), rng.randint(0, 90)) for _ in range(25)]
    got = policy.verify_site(spark.createDataFrame(claims, "img string, low long, high long"), spark.createDataFrame(sites, "img string, site long"), ["img"], "low", "high", "site", width=width).collect()
    want = sorted((i, a, b, any(j == i and a <= s < b for j, s in sites)) for i, a, b in claims)
    assert sorted(tuple(r) for r in got) == want


def test_extent_of_points(spark):
    from cairn.operators.asof import extent_of

    starts = spark.createDataFrame([("i", 10), ("i", 50), ("i", 900)], "img string, va long")
    points = spark.createDataFrame([("i", 5), ("i", 10), ("i", 49), ("i", 60), ("j", 1)], "img string, va long")
    got = {(r.img, r.va): (r.extent_start, r.extent_end) for r in extent_of(points, starts, ["img"], "va", "va", 100).collect()}
    assert got == {("i", 5): (5, 105), ("i", 10): (10, 50), ("i", 49): (10, 50), ("i", 60): (50, 150), ("j", 1): (1, 101)}


def test_members_of_an_overridden_copy_are_gone(spark):
    classes = spark.createDataFrame([("C", None, [], 0, 0), ("C", None, [], 1, 1), ("D", None, [], 1, 1)], "name string, parent string, access array<string>, order int, seq int")
    members = spark.createDataFrame([("C", "method", "here", "()V", 0), ("C", "method", "old", "()V", 1), ("D", "method", "other", "()V", 1)], "owner string, kind string, name string, descriptor string, order int")
    first = linkage.universe(classes.where("order = 0"), classes.where("order > 0"))
    kept = linkage.counted_members(members, first)
    assert {(r.owner, r.name) for r in kept.collect()} == {("C", "here"), ("D", "other")}
    needs = spark.createDataFrame([("method", "C", "old", "()V")], "kind string, owner string, name string, descriptor string")
    none = spark.createDataFrame([], "name string, parent string")
    top = first.withColumn("parent", F.lit("java.lang.Object"))
    assert linkage.resolve_members(needs, top, none, kept).first().outcome == "missing"


def test_last_entry_of_a_kind_counts(spark):
    row = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)],)], "e array<struct<kind:string,n:int>>")
    assert [x.n for x in row.select(policy.last_of_kind(F.col("e")).alias("e")).first().e] == [2, 3, 5]


def test_literals_of_the_driver_and_of_columns_agree(spark):
    texts = ["0x10", "0X1f", "dead", "12", "0b101", "0o17", " 7_000 ", "-0x4", "zz", "", "0x", "1e"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_address(F.col("t")).alias("v")).collect()
    assert {r.t: None if r.v is None else int(r.v) for r in rows} == {t: addresses.address_literal(t) for t in texts}


def test_late_rows_are_left_out(spark, tmp_path):
    from cairn.streaming import ingest

    folder, out = str(tmp_path / "in"), {}

    def keep(batch, number):
        out.update({int(r.s): r.n for r in batch.selectExpr("CAST(start AS LONG) AS s", "n").collect()})

    for minute, name in ((0, "a"), (600, "b"), (1, "late"), (601, "c")):
        spark.sql(f"SELECT timestamp_seconds({minute * 60}) AS ts, '{name}' AS kind").coalesce(1).write.mode("append").parquet(folder)
        counted = ingest.window_counts(spark.readStream.schema("ts timestamp, kind string").parquet(folder), "ts", [], "10 minutes", "1 minute")
        counted.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert out == {0: 1, 36_000: 2}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from cairn import storage

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        storage.shared_dir(Elsewhere)
    table = storage.cut(spark.range(3).toDF("x"), "test-cut")
    path = table._cut_path
    storage.release(table, table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
