import json
import shutil
import struct
import subprocess
import zipfile

import pytest

from cairn.result import Envelope
from cairn.service import Analyst
from tests.test_sources import FIXTURES, minimal_elf, minimal_pe

#: call +6; ret; padding; push; mov eax, 0x67452301; ret
CODE = bytes.fromhex("e806000000 c3 90909090 90 55 b801234567 b889abcdef b8fedcba98 b8aa785ad7 c3".replace(" ", ""))


@pytest.fixture(scope="module")
def analyst(spark, tmp_path_factory):
    return Analyst(spark, f"file://{tmp_path_factory.mktemp('store')}")


@pytest.fixture(scope="module")
def target(tmp_path_factory):
    path = tmp_path_factory.mktemp("bin") / "a.elf"
    path.write_bytes(minimal_elf(CODE + b"\0hello world\0" + struct.pack("<I", 0xE8C7B756)))
    return str(path)


def good(answer):
    assert isinstance(answer, Envelope), answer
    json.loads(answer.to_json())
    return answer


def codes(answer):
    return {w["code"] for w in answer.warnings}


def test_images(analyst, target):
    got = good(analyst.identify(target)).result
    assert (got["format"], got["arch"], got["bits"], got["entry"], got["sections"][0]["perms"]) == ("elf", "x86", 64, "0x401000", "r-x")
    assert good(analyst.sniff(target)).result == {"format": "elf"}
    rows = good(analyst.translate(target, "0x401003")).result
    assert [(r["space"], r["offset"]) for r in rows if r["mapped"]] == [("va", 0x1003)]
    assert "bad_space" in codes(good(analyst.translate(target, "0x1003", "nowhere")))
    assert [r["text"] for r in good(analyst.strings(target, "HELLO")).result] == ["hello world"]
    assert "bad_pattern" in codes(good(analyst.strings(target, "([")))
    assert good(analyst.read(target, "0x401000", 4, "va")).result[0]["hex"] == CODE[:4].hex()
    assert "short_read" in codes(good(analyst.read(target, "0x1000", 4096)))


def test_code(analyst, target):
    got = good(analyst.disasm(target, "0x401000", 3)).result
    assert [r["mnemonic"] for r in got] == ["call", "ret", "nop"] and got[0]["target"] == "0x40100b"
    rows = good(analyst.functions(target)).result
    assert {int(r["va"]): (r["callees"], r["callers"]) for r in rows} == {0x401000: (1, 0), 0x40100B: (0, 1)}
    graph = good(analyst.callgraph(target)).result
    assert (graph["edges"], graph["unattributed"]) == (1, 0)
    assert [int(r["node"]) for r in good(analyst.callgraph(target, "0x401000")).result] == [0x40100B]
    assert [r["via"] for r in good(analyst.xrefs(target, "0x40100b")).result] == ["direct_call"]
    assert "string_not_found" in codes(good(analyst.xrefs(target, "absent text", is_string=True)))
    assert good(analyst.fingerprint(target, "0x40100b")).result["insns"] >= 6
    assert good(analyst.function_cfg(target, "0x401000")).result["complexity"] == 1
    found = {r["name"]: r["verdict"] for r in good(analyst.find_algorithms(target)).result}
    assert found["MD5"] == "identified" and found.get("SHA-1") != "identified"
    assert good(analyst.cache()).result["entries"] >= 1 and good(analyst.cache("clear")).result["cleared"] >= 1


def test_matching_of_two_builds(analyst, target, tmp_path):
    a = good(analyst.build_fingerprints(target, "one")).result
    b = good(analyst.build_fingerprints(target, "two")).result
    got = good(analyst.match_builds(a["path"], b["path"], min_agreeing=1, min_score=0.3))
    assert got.result and {"corroboration_disabled"} <= codes(got) and got.extra["summary"]["matched"] >= 1
    assert analyst.match_builds(str(tmp_path / "none"), b["path"])["error"] == "target_error"


def test_failures_are_answers(analyst, target, tmp_path):
    (tmp_path / "t.txt").write_text("just text, long enough")
    assert analyst.identify(str(tmp_path / "t.txt"))["error"] == "unsupported"
    assert analyst.identify(str(tmp_path))["error"] == "target_error"
    assert analyst.identify("")["error"] == "target_error"
    assert analyst.disasm(target, "0x1")["error"] == "address_error"
    assert analyst.disasm(target, "no address")["error"] == "address_error"
    assert good(analyst.disasm(target, "40100b", 1)).result == good(analyst.disasm(target, "0x40100B", 1)).result  # any literal
    assert analyst.translate(target, "zz")["error"] == "address_error"


def test_knowledge_base(analyst, target, tmp_path):
    assert len(good(analyst.kb_policy()).result["classes"]) == 12
    assert analyst.save_symbol("f", "one", "0x1000", 0.3, ["string_xref"], [])["error"] == "policy_error"
    good(analyst.register_build(target, "one"))
    other = tmp_path / "b.exe"
    other.write_bytes(minimal_pe())
    assert analyst.register_build(str(other), "one")["error"] == "policy_error"
    calls = [{"kind": "callgraph_position", "calls": "0x40100b"}]
    refused = analyst.save_symbol("f", "one", "0x0", 0.4, ["callgraph_position"], [{"kind": "callgraph_position", "calls": "0x401009"}])
    assert refused["context"]["violations"] == ["not_verified"]
    for kind, said in (("string_xref", {"string": "hello world"}), ("import_xref", {"import": "x"}), ("constant_xref", {"constant": 5}), ("symbol_table", {}), ("export_table", {}), ("cross_build_match", {"score": 0.9, "agreeing_signals": 1, "matched_build": "b"})):
        assert analyst.save_symbol("g", "one", "0x1000", 0.2, [kind], [{"kind": kind, **said}])["context"]["violations"] == ["not_verified"], kind
    assert good(analyst.save_symbol("f", "one", "0x0", 0.4, ["callgraph_position"], calls)).result["verified"] == ["callgraph_position"]
    assert good(analyst.save_symbol("k", "one", "0xb", 0.4, ["constant_xref"], [{"kind": "constant_xref", "constant": "0x67452301"}])).result["verified"] == ["constant_xref"]
    got = good(analyst.save_symbol("f", "one", "0x0", 0.2, ["callgraph_position", "community_source"], calls))
    assert got.result["previous_confidence"] == 0.4 and got.result["downgraded"] and "unverified_provenance" in codes(got)
    assert analyst.save_symbol("f", "one", "0x0", 0.9, ["callgraph_position"], calls)["context"]["violations"] == ["above_cap", "needs_corroboration"]
    assert [r["name"] for r in good(analyst.lookup_symbol("F", "one")).result] == ["f"] and not good(analyst.lookup_symbol(min_confidence=0.9)).result


def test_packed_code_is_told_of(analyst, tmp_path):
    path = tmp_path / "p.elf"
    path.write_bytes(minimal_elf(bytes(range(256)) * 16))
    assert {"packed_exec_section", "packed_sections_skipped"} <= codes(good(analyst.functions(str(path))))
    assert {"packed_exec_section", "packed_sections_included"} <= codes(good(analyst.functions(str(path), include_packed=True)))


@pytest.fixture(scope="module")
def jars(tmp_path_factory):
    """A host in two versions and a plug-in compiled against the first."""
    if not shutil.which("javac"):
        pytest.skip("no Java compiler")
    base = tmp_path_factory.mktemp("api")
    sources = {
        "v1": {"p/Host.java": "package p; public interface Host { void start(); default void stop() {} }", "p/Base.java": "package p; public class Base { public void size(int n) {} }"},
        "v2": {"p/Host.java": "package p; public interface Host { void start(); void extra(); default void stop() {} }", "p/Base.java": "package p; public class Base { public void size(long n) {} }"},
        "plug": {"q/Plug.java": "package q; public class Plug extends p.Base implements p.Host { public void start() { size(1); } public void size(int n) {} }"},
    }
    out = {}
    for name, files in sources.items():
        src, classes = base / name / "src", base / name / "classes"
        classes.mkdir(parents=True)
        for f, text in files.items():
            (src / f).parent.mkdir(parents=True, exist_ok=True)
            (src / f).write_text(text)
        path = ["-cp", str(base / "v1" / "classes")] if name == "plug" else []
        subprocess.run(["javac", "-g", *path, "-d", str(classes), *map(str, src.rglob("*.java"))], check=True)
        out[name] = str(base / f"{name}.jar")
        with zipfile.ZipFile(out[name], "w") as z:
            z.writestr("META-INF/MANIFEST.MF", "Manifest-Version: 1.0\n")
            for c in classes.rglob("*.class"):
                z.write(c, c.relative_to(classes))
    return out


def test_linkage_and_health_over_versions(analyst, jars):
    ok = good(analyst.jvm_linkage(jars["plug"], [jars["v1"]], ["q.Plug", "q.Plugg"]))
    assert ok.result["scorecard"]["missing_classes"] == 0 and ok.result["scorecard"]["missing_members"] == 0
    assert [r["ok"] for r in sorted(ok.result["entrypoints"], key=lambda r: r["entrypoint"])] == [True, False] and "entrypoint_will_not_load" in codes(ok)
    alone = good(analyst.jvm_linkage(jars["plug"]))
    assert {r["owner"] for r in alone.result["missing_classes"]} == {"p.Base", "p.Host"} and {"incomplete_classpath", "unresolved_references"} <= codes(alone)
    fine = good(analyst.jvm_health(jars["plug"], [jars["v1"]]))
    assert fine.result == {"unimplemented": [], "broken_overrides": []}
    drift = good(analyst.jvm_health(jars["plug"], [jars["v2"]]))
    assert [r["name"] for r in drift.result["unimplemented"]] == ["extra"] and [r["name"] for r in drift.result["broken_overrides"]] == ["size"]
    # the first copy of a class counts, with its members alone
    both = good(analyst.jvm_linkage(jars["plug"], [jars["v2"], jars["v1"], "/nowhere.jar"]))
    assert "classpath_entry_unusable" in codes(both) and [x["usable"] for x in both.result["sources"]] == [True, True, False]
    twice = good(analyst.jvm_duplicates([jars["v1"], jars["v2"]]))
    assert [r["name"] for r in twice.result] == ["p.Base", "p.Host"] and not good(analyst.jvm_duplicates([jars["v1"]])).result


def test_managed_answers(analyst, jars, tmp_path):
    got = good(analyst.java(jars["v1"], "host"))
    assert [c["name"] for c in got.result["classes"]] == ["p.Host"] and got.result["packages"] == {"p": 2}
    assert "size(I)V" in good(analyst.jvm_disasm(jars["plug"], "q.Plug")).result
    text = good(analyst.jvm_decompile(jars["plug"], "q.Plug", "start")).result["start()V"]
    assert "this.size(1);" in text
    assert good(analyst.jvm_cfg(jars["plug"], "q.Plug", "start")).result["start()V"]["complexity"] == 1
    assert len(good(analyst.jvm_methods(jars["plug"], "plug", "siz")).result) == 1
    missing = analyst.jvm_decompile(jars["plug"], "q.Plugs")
    assert missing["error"] == "target_error"
    if shutil.which("javac"):
        subprocess.run(["javac", "-g", "-d", str(tmp_path), str(FIXTURES / "Sample.java")], check=True)
        assert good(analyst.java(str(tmp_path / "demo" / "Sample.class"))).result["name"] == "demo.Sample"
    plain = tmp_path / "a.exe"
    plain.write_bytes(minimal_pe())
    assert analyst.dotnet(str(plain))["error"] == "format_error"
