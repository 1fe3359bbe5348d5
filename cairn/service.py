"""The queries a user asks of files, each answered as JSON with warnings; failures are answers too."""

from __future__ import annotations

import json
from collections import OrderedDict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.cache import Cache, Snapshots
from cairn.jvm import bytecode, cfg, decompile, methods
from cairn.operators import addresses, catalog, graph, linkage, matching, policy, xrefs
from cairn.operators.asof import asof_join, extent_of
from cairn.operators.grouping import duplicates
from cairn.operators.text import matching as matching_text
from cairn.result import AddressError, Envelope, PolicyError, TargetError, guarded, limited
from cairn.sources import algorithms, containers, managed, native, tables
from cairn.storage import shared_dir


#: Images kept in memory (by path, time and size), and width of the ranges that as-of joins cut an image into.
MEMO, WIDTH = 8, float(1 << 22)


def _address(text: str) -> int:
    value = addresses.address_literal(text)
    if value is None:
        raise AddressError("not an address", address=text)
    return value


class Analyst:
    """Answers about local or shared files; every public method returns an ``Envelope`` or an error dictionary."""

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark = spark
        self.store = (store or f"{shared_dir(spark)}/cairn-store").rstrip("/")
        self.cached = Cache(spark, f"{self.store}/cache")
        self.memo: OrderedDict = OrderedDict()
        self.symbols, self.builds = Snapshots(spark, f"{self.store}/symbols"), Snapshots(spark, f"{self.store}/builds")

    # ---- what all answers need

    def _files(self, path: str) -> DataFrame:
        if "://" not in path and path.strip() and Path(path).expanduser().is_dir() and any(Path(path).expanduser().rglob("*.class")):
            return tables.files(self.spark, f"file://{Path(path).expanduser().resolve()}", "*.class", recursive=True)
        return tables.files(self.spark, path if "://" in path else f"file://{tables.check_target(path)}")

    def _bytes(self, path: str) -> tuple[str, bytes]:
        """Hash and bytes of a file, remembered by path, time and size."""
        stamp = None
        if "://" not in path and path.strip() and Path(path).expanduser().is_file():
            info = Path(path).expanduser().stat()
            stamp = (path, info.st_mtime_ns, info.st_size)
            if stamp in self.memo:
                self.memo.move_to_end(stamp)
                return self.memo[stamp]
        row = self._files(path).select("sha256", "content").first()
        if row is None:
            raise TargetError("nothing to read", path=path)
        got = row[0], bytes(row[1])
        if stamp is not None:
            self.memo[stamp] = got
            while len(self.memo) > MEMO:
                self.memo.popitem(last=False)
        return got

    def _image(self, path: str, **raw) -> tuple[str, bytes, containers.Image, Envelope]:
        sha, data = self._bytes(path)
        image = containers.load(data, **raw)
        out = Envelope()
        for w in containers.image_warnings(image, data):
            out.warn(w["code"], w["detail"], w["impact"])
        return sha, data, image, out

    def _index(self, path: str, include_packed: bool = False, out: Envelope | None = None) -> DataFrame:
        """The code index, kept by content; ``out`` gets the warnings about it, which are kept beside it."""
        sha, _ = self._bytes(path)
        params = {"packed": include_packed}
        if out is not None:
            told = self.cached.get_or_build(sha, "warnings", params, lambda: tables.warnings(self._files(path), include_packed, indexed=True))[0]
            known = {w["code"] for w in out.warnings}
            for w in told.orderBy("code").collect():
                if w.code not in known:
                    out.warn(w.code, w.detail, w.impact)
        return self.cached.get_or_build(sha, "code", params, lambda: tables.code_index(self._files(path), include_packed))[0]

    def _rows(self, df: DataFrame, limit: int, out: Envelope | None = None) -> Envelope:
        got = limited(df, limit)
        if out is None:
            return got
        out.result = got.result
        out.warnings += got.warnings
        return out

    @staticmethod
    def _section(image, va):
        return next((s for s in reversed(image.sections) if s.va <= va < s.va + max(s.vsize, s.filesize)), None)

    # ---- images

    @guarded
    def identify(self, path: str):
        sha, data, image, out = self._image(path)
        out.result = {
            "sha256": sha, "size": len(data), "format": image.format, "arch": image.arch, "bits": image.bits, "endian": image.endian, "image_base": hex(image.image_base), "entry": image.entry and hex(image.entry), "library": image.is_library, "notes": image.notes, "imports": len(image.imports), "exports": len(image.exports), "symbols": len(image.symbols),
            "sections": [{"name": s.name, "va": hex(s.va), "vsize": s.vsize, "fileoff": s.fileoff, "filesize": s.filesize, "perms": "".join(c if on else "-" for c, on in zip("rwx", (s.r, s.w, s.x))), "entropy": round(containers.entropy(data[s.fileoff : s.fileoff + s.filesize]) or 0, 3)} for s in image.sections],
        }
        if not native.supported(image.arch, image.bits, image.endian):
            out.warn("no_decoder", f"{image.arch}/{image.bits}/{image.endian}")
        return out

    @guarded
    def sniff(self, path: str):
        return Envelope({"format": containers.sniff(self._bytes(path)[1][:4096])})

    @guarded
    def translate(self, path: str, address: str, space: str = "auto"):
        _, _, image, out = self._image(path)
        found = self._files(path)
        if space not in ("auto", "va", "rva", "file"):
            out.warn("bad_space", f"{space!r} is unknown; all spaces are tried")
            space = "auto"
        point = found.select("sha256", addresses.parse_address(F.lit(address)).alias("address"))
        if point.first()[1] is None:
            raise AddressError("not an address", address=address)
        got = addresses.translate(point, tables.sections(found), tables.images(found).select("sha256", "image_base"), ["sha256"], width=WIDTH)
        return self._rows(got if space == "auto" else got.where(F.col("space") == space), 10, out)

    @guarded
    def strings(self, path: str, pattern: str = "", least: int = 5, referenced_only: bool = False, limit: int = 200):
        _, _, image, out = self._image(path)
        found = self._files(path)
        rows = tables.strings(found, least, image.endian == "big")
        if pattern:
            rows, warnings = matching_text(rows, "text", pattern)
            out.warnings += warnings
        sections = tables.sections(found).select("sha256", "va", "fileoff", "filesize")
        placed = addresses.offset_to_va(rows, sections, ["sha256"], width=WIDTH)
        if native.supported(image.arch, image.bits, image.endian):
            placed = xrefs.annotate(placed, self._index(path, out=out).where("kind = 'reference'"), ["sha256"])
            placed = placed.where("xrefs > 0") if referenced_only else placed
        return self._rows(placed.orderBy("offset", "encoding"), limit, out)

    @guarded
    def disasm(self, path: str, address: str, count: int = 40, **raw):
        _, data, image, out = self._image(path, **raw)
        va = _address(address)
        s = self._section(image, va)
        if s is None or va - s.va >= s.filesize:
            raise AddressError("no bytes at this address", address=address, sections=[f"{x.name} {x.va:#x} {x.va + max(x.vsize, x.filesize):#x}" for x in image.sections])
        if not s.x:
            out.warn("non_executable_section", s.name, "unreliable")
        native.sweep(b"", va, image.arch, image.bits, image.endian)
        got = tables.listing(self._files(path), va, count, **raw).orderBy("va").drop("sha256", "executable").collect()
        out.result = [{"va": hex(int(r.va)), "bytes": r.bytes, "mnemonic": r.mnemonic, "operands": r.operands, "target": None if r.target is None else hex(int(r.target))} for r in got]
        return out if got else out.warn("no_instructions", "nothing could be decoded", "unreliable")

    @guarded
    def xrefs(self, path: str, target: str, is_string: bool = False, limit: int = 200):
        sha, _, image, out = self._image(path)
        found = self._files(path)
        sections = tables.sections(found)
        places = sections.select("sha256", "va", "fileoff", "filesize")
        if is_string:
            wanted = self.spark.createDataFrame([(sha, target)], "sha256 string, string string")
            asked = addresses.offset_to_va(tables.string_places(found, wanted), places, ["sha256"], width=WIDTH).where("va IS NOT NULL").select("sha256", F.col("va").alias("target")).distinct()
            if asked.isEmpty():
                return Envelope([], out.warnings).warn("string_not_found", target)
        else:
            va = _address(target)
            if self._section(image, va) is None:
                raise AddressError("unmapped", address=target)
            asked = self.spark.sql(f"SELECT '{sha}' AS sha256, CAST({va} AS {addresses.ADDRESS}) AS target")
        rows = xrefs.to_targets(asked, self._index(path, out=out), tables.stored_addresses(found, asked), sections, ["sha256"], native.MOST_SITES, WIDTH)
        return self._rows(rows.drop("sha256").orderBy("via", "site"), limit, out)

    def _graph(self, path: str, include_packed: bool = False, out: Envelope | None = None):
        """Files, function starts, and call sites with the functions they are in: ``src, dst, kind, detail``."""
        found, index = self._files(path), self._index(path, include_packed, out)
        starts = tables.functions(found, include_packed).select("sha256", "va", F.col("va").alias("func"))
        sites = index.where("kind IN ('call', 'import', 'indirect_call')").select("sha256", F.col("site").alias("va"), "kind", "target", "detail")
        placed = asof_join(sites, starts, ["sha256"], "va", ["func"], WIDTH)
        return found, starts, placed.select(F.col("func").alias("src"), F.when(F.col("kind") != "import", F.col("target")).alias("dst"), F.when(F.col("kind") == "import", "import").otherwise("call").alias("kind"), "detail")

    @guarded
    def functions(self, path: str, limit: int = 200, named_only: bool = False, include_packed: bool = False):
        _, _, image, out = self._image(path)
        found, starts, sites = self._graph(path, include_packed, out)
        names = tables.symbols(found).select(F.col("va").alias("node"), "name", "ord")
        calls = sites.where("kind = 'call' AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
        imports = sites.where("kind = 'import' AND src IS NOT NULL").select("src", F.col("detail").alias("name"))
        rows = graph.busiest(calls, names, imports, starts=starts.select(F.col("va").alias("node"))).withColumnRenamed("node", "va")
        if named_only:
            rows = rows.where("name IS NOT NULL")
        if not image.symbols and not image.exports:
            out.warn("no_symbol_evidence", "starts come from the entry, call targets and prologues alone")
        return self._rows(rows, limit, out)

    @guarded
    def callgraph(self, path: str, focus: str = "", depth: int = 1, include_packed: bool = False):
        _, _, _, out = self._image(path)
        _, _, sites = self._graph(path, include_packed, out)
        edges = sites.where("kind = 'call' AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
        if focus:
            start = self.spark.sql(f"SELECT CAST({_address(focus)} AS {addresses.ADDRESS}) AS origin")
            return self._rows(graph.neighbourhood(edges, start, max(1, depth)).orderBy("direction", "level", "node"), 5000, out)
        totals = graph.summary(sites).first().asDict()
        out.result = {**totals, "top": [r.asDict() for r in graph.widest(edges).collect()]}
        return out.warn("indirect_calls_unresolved", str(totals["indirect"])) if totals["indirect"] else out

    @guarded
    def fingerprint(self, path: str, address: str):
        got = tables.fingerprints(self._files(path)).where(F.col("va") == _address(address)).first()
        if got is None:
            raise AddressError("no function of two instructions starts here", address=address)
        return Envelope(got.asDict())

    @guarded
    def build_fingerprints(self, path: str, build_id: str, out_path: str = ""):
        where = out_path or f"{self.store}/fingerprints"
        rows = tables.fingerprints(self._files(path)).withColumn("build_id", F.lit(build_id))
        rows.write.mode("overwrite").parquet(f"{where}/build_id={build_id}")
        got = self.spark.read.parquet(f"{where}/build_id={build_id}")
        out = Envelope({"path": f"{where}/build_id={build_id}", "functions": got.count(), **got.agg(*[F.count_if(F.size(c) > 0).alias(c) for c in ("strings", "imports", "constants", "ngrams")]).first().asDict()})
        return out if any(out.result[c] for c in ("strings", "imports", "constants")) else out.warn("no_content_features", "only shapes and n-grams are there to match by")

    @guarded
    def match_builds(self, a: str, b: str, min_score: float = 0.55, min_agreeing: int = 2, top: int = 3, limit: int = 100):
        def read(path):
            try:
                rows = self.spark.read.parquet(path)
            except Exception as e:
                raise TargetError("no fingerprints here", path=path) from e
            return rows.select(F.col("va").alias("key"), "strings", "imports", "constants", "ngrams", "signature", F.col("insns").alias("size"), "calls", "branches", "returns")

        left = read(a)
        found = matching.match(left, read(b), min_score=min_score, min_agreeing=min_agreeing, top=top)
        summary = matching.ambiguity(found, left).first().asDict()
        out = self._rows(found.orderBy(F.desc("score"), F.desc("agreeing"), "a", "b"), limit)
        out.extra["summary"] = summary
        if summary["ambiguous"]:
            out.warn("ambiguous_matches", str(summary["ambiguous"]))
        return out.warn("corroboration_disabled", "one agreeing signal is enough") if min_agreeing < 2 else out

    @guarded
    def read(self, path: str, address: str, length: int = 64, space: str = "file"):
        _, data, image, out = self._image(path)
        at = _address(address)
        if space != "file":
            va = at + (image.image_base if space == "rva" else 0)
            s = self._section(image, va)
            if s is None or va - s.va >= s.filesize:
                raise AddressError("no file bytes at this address", address=address, space=space)
            at = s.fileoff + va - s.va
        rows = self._rows(tables.dump(self._files(path), at, length), 4096 // 16, out)
        return rows.warn("short_read", f"{len(data) - at} bytes are left") if at + min(length, 4096) > len(data) else rows

    @guarded
    def find_algorithms(self, path: str, include_leads: bool = True):
        _, _, image, out = self._image(path)
        found = self._files(path)
        hit = tables.algorithm_hits(found)
        got = catalog.verdicts(hit, algorithms.dimension(self.spark))
        rows = self._rows(got if include_leads else got.where("verdict = 'identified'"), 100, out)
        if native.supported(image.arch, image.bits, image.endian):
            users = xrefs.algorithm_users(hit, self._index(path, out=out), tables.functions(found), tables.sections(found), ["sha256"], width=WIDTH)
            listed = {}
            for r in users.orderBy("name", "rank").collect():
                listed.setdefault(r["name"], []).append({"function": hex(int(r["function"])), "refs": r["refs"]})
            for r in rows.result:
                r["used_by"] = listed.get(r["name"], [])
        return rows if rows.result else rows.warn("no_algorithms_found", "none of the markers occur")

    @guarded
    def function_cfg(self, path: str, address: str):
        _, _, image, out = self._image(path)
        va = _address(address)
        if self._section(image, va) is None:
            raise AddressError("unmapped", address=address)
        native.sweep(b"", va, image.arch, image.bits, image.endian)
        row = tables.control_flow(self._files(path), va).drop("sha256").first()
        if row is None:
            return out.warn("no_instructions", "nothing could be decoded", "unreliable")
        out.result = row.asDict(recursive=True)
        return out if any(x.va == va for x in image.symbols) else out.warn("estimated_boundaries", "the function's end is the next known start")

    # ---- managed code

    @guarded
    def java(self, path: str, class_name: str = "", limit: int = 200):
        _, data = self._bytes(path)
        if data[:4] == b"\xca\xfe\xba\xbe":
            c = managed.parse_class(data)
            return Envelope({"name": c.name, "parent": c.parent, "interfaces": c.interfaces, "access": c.access, "java": managed.java_version(c.major), "fields": [m.name for m in c.fields], "methods": [m.name + m.descriptor for m in c.methods]})
        got = managed.scan_jar(data)
        part = class_name.lower()
        rows = [c for c in got["classes"] if part in c["name"].lower() or part in c["entry"].lower()]
        top = sorted(got["packages"].items(), key=lambda x: -x[1])[:25]
        out = Envelope({"classes": rows[:limit], "resources": got["resources"], "manifest": got["manifest"], "packages": dict(top), "unparsed": got["unparsed"]})
        if len(rows) > limit:
            out.warn("result_limited", f"{limit} of {len(rows)} rows")
        if got["truncated"]:
            out.warn("scan_truncated", "there are more classes")
        return out.warn("unparsed_entries", str(len(got["unparsed"]))) if got["unparsed"] else out

    @guarded
    def dotnet(self, path: str, pattern: str = "", heap: str = "both", limit: int = 300):
        out = Envelope()
        got = tables.assemblies(self._files(path))
        row = got.first()
        if row is None:
            managed.parse_cli(self._bytes(path)[1])  # says what is wrong
        if heap not in ("both", "strings", "user"):
            out.warn("bad_heap", f"{heap!r} is unknown; both are shown")
        out.result = {"runtime": row["runtime"], "version": row["version"], "streams": row["streams"], "table_rows": row["table_rows"]}
        for name, column, wanted in (("identifiers", "identifiers", "strings"), ("user_strings", "user_strings", "user")):
            if heap in (wanted, "both") or heap not in ("strings", "user"):
                items = got.select(F.posexplode(column).alias("i", "text"))
                if pattern:
                    items, warnings = matching_text(items, "text", pattern)
                    out.warnings += warnings
                part = limited(items.orderBy("i").select("text"), limit)
                out.result[name] = [r["text"] for r in part.result]
                out.warnings += part.warnings
        return out

    def _class(self, path: str, class_name: str):
        entries = list(tables.class_entries(self._bytes(path)[1]))
        wanted = class_name.replace(".", "/").removesuffix("/class")
        for exact in (True, False):
            for entry, body in entries:
                bare = entry.removesuffix(".class")
                if not entry or (bare == wanted if exact else bare.endswith(wanted)):
                    return managed.parse_class(body)
        near = [e for e, _ in entries if wanted.rpartition("/")[2].lower() in e.lower()][:10]
        raise TargetError("no such class", class_name=class_name, near=near)

    def _methods(self, path: str, class_name: str, method: str):
        c = self._class(path, class_name)
        found = [m for m in c.methods if not method or m.name == method]
        if not found:
            raise TargetError("no such method", method=method, methods=sorted({m.name for m in c.methods}))
        return c, found

    @guarded
    def jvm_methods(self, path: str, class_name: str = "", pattern: str = "", limit: int = 200):
        rows = methods.control_flow(self._files(path))
        if class_name:
            rows = rows.where(F.contains(F.lower("owner"), F.lit(class_name.lower())))
        out = Envelope()
        if pattern:
            rows, out.warnings = matching_text(rows, "method", pattern)
        return self._rows(rows.orderBy(F.desc("complexity"), "owner", "method", "descriptor"), limit, out)

    @guarded
    def jvm_disasm(self, path: str, class_name: str, method: str = ""):
        c, found = self._methods(path, class_name, method)
        out = Envelope({m.name + m.descriptor: [f"{i.pc}: {bytecode.text(i, c.pool)}" for i in bytecode.decode(m.code.code)[0]] for m in found if m.code})
        return out if all(m.code for m in found) else out.warn("no_code", "abstract or native methods have none")

    @guarded
    def jvm_decompile(self, path: str, class_name: str, method: str = "", limit: int = 40):
        c, found = self._methods(path, class_name, method)
        text = {m.name + m.descriptor: decompile.method_text(c, m) for m in found[:limit] if m.code}
        out = Envelope({k: t for k, (t, _) in text.items()})
        if len(found) > limit:
            out.warn("result_limited", f"{limit} of {len(found)} methods")
        if not all(s for _, s in text.values()):
            out.warn("approximate_structure", ", ".join(k for k, (_, s) in text.items() if not s))
        if any(m.code and not m.code.locals for m in found):
            out.warn("no_debug_names", "the class was compiled without names of locals")
        return out

    @guarded
    def jvm_cfg(self, path: str, class_name: str, method: str):
        _, found = self._methods(path, class_name, method)
        return Envelope({m.name + m.descriptor: cfg.summary(m.code) for m in found if m.code})

    def _linkage(self, path: str, classpath: list[str]):
        """Files, the classes that count, interfaces, their members, requirements, and what became of every source."""
        own, provided, sources = self._files(path), [], []
        for p in classpath:
            try:
                files = self._files(p)
                sources.append({"source": p, "classes": tables.classes(files).count(), "usable": True})
                provided.append(files)
            except (TargetError, containers.FormatError) as e:
                sources.append({"source": p, "classes": 0, "usable": False, "reason": str(e)})
        every = [own, *provided]

        def together(make):
            out = make(own).withColumn("order", F.lit(0))
            for n, files in enumerate(provided, 1):
                out = out.unionByName(make(files).withColumn("order", F.lit(n)))
            return out

        ranked = together(tables.classes).select("name", "parent", "access", "interfaces", "order", F.struct("order", "entry", "sha256").alias("seq"))
        first = linkage.universe(ranked.where("order = 0"), ranked.where("order > 0"))
        interfaces = first.select("name", F.explode("interfaces").alias("parent"))
        return every, first, interfaces, linkage.counted_members(together(tables.members), first), tables.requirements(own), sources

    @guarded
    def jvm_linkage(self, path: str, classpath: list[str] = (), entrypoints: list[str] = (), limit: int = 40):
        _, classes, interfaces, members, needs, sources = self._linkage(path, list(classpath))
        resolved = linkage.resolve_members(needs, classes, interfaces, members)
        card = linkage.scorecard(needs, classes, resolved).first().asDict()
        lost = limited(linkage.missing_owners(needs, classes).orderBy("owner"), limit)
        out = Envelope({"scorecard": card, "missing_classes": lost.result, "missing_members": limited(resolved.where("outcome = 'missing'").orderBy("owner", "name"), limit).result, "sources": sources}, lost.warnings)
        for x in sources:
            if not x["usable"] or not x["classes"]:
                out.warn("classpath_entry_unusable", x["source"])
        if card["missing_classes"] or card["missing_members"]:
            out.warn("unresolved_references", "some references cannot be linked", "unreliable")
        if entrypoints:
            wanted = self.spark.createDataFrame([(e,) for e in entrypoints], "entrypoint string")
            out.result["entrypoints"] = [r.asDict() for r in linkage.entrypoints(wanted, classes, members).collect()]
            if not all(r["ok"] for r in out.result["entrypoints"]):
                out.warn("entrypoint_will_not_load", "see the problems listed", "unreliable")
        return out if classpath else out.warn("incomplete_classpath", "no classpath was given")

    @guarded
    def jvm_health(self, path: str, classpath: list[str] = (), data_files: str = "", limit: int = 40):
        _, classes, interfaces, members, _, _ = self._linkage(path, list(classpath))
        own = tables.classes(self._files(path)).select(F.col("name").alias("owner")).distinct()
        bare = limited(linkage.unimplemented(classes, interfaces, members).join(own, "owner", "left_semi").orderBy("owner", "name"), limit)
        broken = limited(linkage.broken_overrides(classes, interfaces, members).join(own, "owner", "left_semi").orderBy("owner", "name"), limit)
        out = Envelope({"unimplemented": bare.result, "broken_overrides": broken.result}, bare.warnings + broken.warnings)
        if bare.result:
            out.warn("unimplemented_abstract_methods", str(len(bare.result)), "unreliable")
        if broken.result:
            out.warn("possible_broken_overrides", str(len(broken.result)))
        if data_files:
            root = data_files if "://" in data_files else f"file://{Path(data_files).expanduser().resolve()}"
            text = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(linkage.DATA_SUFFIXES)}}}").text(root, wholetext=True)
            start = len(root.removeprefix("file://").rstrip("/")) + 2
            path_in = F.expr(f"substring(regexp_replace(_metadata.file_path, '^file:/+', '/'), {start})") if root.startswith("file://") else F.replace(F.col("_metadata.file_path"), F.lit(root.rstrip("/") + "/"), F.lit(""))
            refs = linkage.class_names(text.select("value", path_in.alias("file")).where(linkage.is_data_path(F.col("file"))), "file", "value")
            lost = limited(linkage.data_references(refs, classes).orderBy("class"), limit)
            out.result["data_references"] = lost.result
            if any(r["kind"] == "missing" for r in lost.result):
                out.warn("unresolvable_data_references", "data names classes that are gone", "unreliable")
        return out

    @guarded
    def jvm_duplicates(self, paths: list[str], limit: int = 1000):
        rows = None
        for p in paths:
            one = tables.classes(self._files(p)).select("name", F.lit(p).alias("source"))
            rows = one if rows is None else rows.unionByName(one)
        out = self._rows(duplicates(rows, "name", "source").orderBy("name"), limit)
        return out.warn("duplicate_class_definitions", str(len(out.result))) if out.result else out

    # ---- knowledge base

    @guarded
    def kb_policy(self):
        return Envelope({"classes": [r.asDict() for r in policy.document(self.spark).collect()], "corroborate_above": policy.CORROBORATE_ABOVE, "corroborate_with": policy.CORROBORATE_WITH})

    @guarded
    def register_build(self, path: str, build_id: str):
        sha, _ = self._bytes(path)
        new = self.spark.createDataFrame([(build_id, sha, path)], "build_id string, sha256 string, path string")
        known = self.builds.read()
        if known is None:
            self.builds.save(new)
            return Envelope({"build_id": build_id, "sha256": sha})
        kept, rejected = policy.register_builds(known, new)
        if not rejected.isEmpty():
            raise PolicyError("this build has another content", build_id=build_id)
        self.builds.save(kept)
        return Envelope({"build_id": build_id, "sha256": sha})

    def _borne_out(self, build, rva: str, provenance: list[str], evidence: list[dict]) -> list[str]:
        """The classes among ``provenance`` whose evidence the build's own bytes bear out."""
        asked = [n for n, _, verifiable, _ in policy.PROVENANCE if verifiable and n in provenance]
        if not asked:
            return []
        sha, _ = self._bytes(build.path)
        if sha != build.sha256:
            raise PolicyError("the build's file has changed", build_id=build.build_id)
        by_kind = {e.get("kind"): e for e in evidence}
        image = containers.load(self._bytes(build.path)[1])
        va, said = image.image_base + _address(rva), {}

        def number(value):
            return None if value is None else _address(value) if isinstance(value, str) else int(value)

        for name, keys in (("string_xref", ("string",)), ("import_xref", ("import",)), ("constant_xref", ("constant",)), ("callgraph_position", ("calls", "called_by")), ("cross_build_match", ("score", "agreeing_signals", "matched_build"))):
            said |= {k: by_kind.get(name, {}).get(k) for k in keys}
        found = self._files(build.path)
        values = [("c", sha, str(va), said["string"], said["import"], number(said["constant"]), number(said["calls"]), number(said["called_by"]), None if said["score"] is None else float(said["score"]), None if said["agreeing_signals"] is None else int(said["agreeing_signals"]), said["matched_build"])]
        claims = self.spark.createDataFrame(values, "claim string, sha256 string, va string, string string, import string, constant long, calls long, called_by long, score double, agreeing int, matched_build string")
        for c in ("va", "calls", "called_by"):
            claims = claims.withColumn(c, F.col(c).cast(addresses.ADDRESS))
        starts = tables.functions(found).select("sha256", "va")
        claims = extent_of(claims, starts, ["sha256"], "va", "va", native.MOST_BYTES).withColumnsRenamed({"extent_start": "low", "extent_end": "high"})
        index = self._index(build.path)
        refs, sections = index.where("kind = 'reference'").select("sha256", "site", "target"), tables.sections(found).select("sha256", "va", "fileoff", "filesize")
        _, _, sites = self._graph(build.path)

        def string_xref():
            places = addresses.offset_to_va(tables.string_places(found, claims.where("string IS NOT NULL")), sections, ["sha256"])
            return policy.verify_string_xref(claims, places, refs)

        def import_xref():
            called = index.where("kind = 'import'").select("sha256", "site", F.col("detail").alias("qualified"))
            return policy.verify_import_xref(claims, called, tables.imports(found).where("slot IS NOT NULL").select("sha256", "slot", "qualified"), refs)

        checks = {
            "string_xref": string_xref,
            "import_xref": import_xref,
            "constant_xref": lambda: policy.verify_constant_xref(claims, tables.fingerprints(found)),
            "callgraph_position": lambda: policy.verify_callgraph_position(claims, sites.where("kind = 'call'").select(F.lit(sha).alias("sha256"), "src", "dst")),
            "symbol_table": lambda: policy.verify_named(claims, tables.symbols(found).where("source <> 'export'")),
            "export_table": lambda: policy.verify_named(claims, tables.symbols(found).where("source = 'export'")),
            "cross_build_match": lambda: policy.verify_cross_build_match(claims),
        }
        return policy.verified_classes(claims.select("claim"), {n: checks[n]() for n in asked}).first()["verified"]

    @guarded
    def save_symbol(self, name: str, build_id: str, rva: str, confidence: float, provenance: list[str], evidence: list[dict]):
        builds = self.builds.read()
        build = None if builds is None else builds.where(F.col("build_id") == build_id).first()
        if build is None:
            raise PolicyError("register the build first", build_id=build_id)
        schema = "name string, build_id string, rva string, confidence double, provenance array<string>, evidence array<struct<kind:string,artifact:string,said:string>>"
        claim = self.spark.createDataFrame([(name, build_id, rva, float(confidence), list(provenance), [(e.get("kind"), e.get("artifact") or e.get("reference"), json.dumps(e, sort_keys=True)) for e in evidence])], schema)
        first = policy.evaluate(claim).first()
        if not first.accepted:
            raise PolicyError("the claim breaks the policy", violations=first.violations)
        sure = self._borne_out(build, rva, list(provenance), evidence)
        claim = claim.withColumn("verified", F.array(*[F.lit(c) for c in sure]).cast("array<string>"))
        verdict = policy.evaluate(claim, "verified").first()
        if not verdict.accepted:
            raise PolicyError("the claim breaks the policy", violations=verdict.violations)
        saved = policy.stamped(claim).withColumn("seq", F.lit((self.symbols.version() or 0) + 1))
        before = self.symbols.read()
        self.symbols.save(saved if before is None else before.unionByName(saved))
        state = policy.revisions(self.symbols.read().select("name", "build_id", "seq", "confidence"), ["name", "build_id"], ["seq"]).where((F.col("name") == name) & (F.col("build_id") == build_id)).first()
        out = Envelope({"name": name, "build_id": build_id, "confidence": confidence, "verified": sure, "revisions": state.revisions, "previous_confidence": state.previous_confidence, "downgraded": state.downgraded})
        loose = [n for n, _, v, _ in policy.PROVENANCE if n in provenance and not v]
        return out.warn("unverified_provenance", ", ".join(loose)) if loose else out

    @guarded
    def lookup_symbol(self, query: str = "", build_id: str = "", min_confidence: float = 0.0, limit: int = 50):
        rows = self.symbols.read()
        if rows is None:
            return Envelope([])
        last = policy.revisions(rows.select("name", "build_id", "seq", "confidence", "rva"), ["name", "build_id"], ["seq"])
        return self._rows(policy.lookup(last, query or None, build_id or None, min_confidence, ("name", "rva")), limit)

    @guarded
    def cache(self, action: str = "stats", sha256: str = ""):
        if action == "clear":
            return Envelope({"cleared": self.cached.clear(sha256 or None)})
        return Envelope(self.cached.stats())
