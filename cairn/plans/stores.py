"""Queries of stores, limits, files and answers (survey ids SNK, TOP-10, EVD, SRC-01, SRC-14, FLT-14)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cairn.cache import Cache, Snapshots
from cairn.operators import graph, grouping, policy, text
from cairn.plans import forge
from cairn.plans.registry import query
from cairn.result import Envelope, guarded, limited
from cairn.session import table
from cairn.sources import managed, tables
from cairn.storage import shared_path


@query(
    "kb_snapshots",
    """
    SELECT s_suppkey AS id, CAST(3 AS INTEGER) AS version, s_nationkey * 3 AS state FROM supplier
    """,
)
def kb_snapshots(spark, sf_dir):
    """SNK-02: a table saved three times behind a pointer: the last version is read, the one before is kept."""
    store = Snapshots(spark, shared_path(spark, "snapshots"))
    for n in (1, 2, 3):
        version = store.save(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * n).alias("state")))
    return store.read().select("id", F.lit(version).alias("version"), "state")


@query(
    "cached_tables",
    "SELECT * FROM (VALUES ('first', false, CAST(25 AS BIGINT)), ('again', true, 25), ('other parameters', false, 5), ('damaged', false, 25)) AS t(step, was_there, rows)",
)
def cached_tables(spark, sf_dir):
    """SNK-03: tables kept by content and parameters; a damaged one is built anew."""
    cache, sha = Cache(spark, shared_path(spark, "cache")), "ab" * 32
    nations, steps = table(spark, sf_dir, "nation"), []

    def ask(step, region=None):
        made = nations if region is None else nations.where(F.col("n_regionkey") == region)
        got, was_there = cache.get_or_build(sha, "nations", {"region": region}, lambda: made)
        steps.append((step, was_there, got.count()))

    ask("first")
    ask("again")
    ask("other parameters", 1)
    for entry in cache.entries():
        spark.range(1).selectExpr("CAST(id AS STRING) AS value").coalesce(1).write.mode("overwrite").text(f"{cache.root}/{entry}")  # no table any more
    ask("damaged")
    return spark.createDataFrame(steps, "step string, was_there boolean, rows long")


@query("cache_cleared", "SELECT CAST(3 AS INTEGER) AS entries, CAST(2 AS INTEGER) AS cleared, CAST(1 AS INTEGER) AS kept")
def cache_cleared(spark, sf_dir):
    """SNK-04: entries of one content are cleared, others stay."""
    cache = Cache(spark, shared_path(spark, "cache"))
    for sha, name in (("aa" * 32, "one"), ("aa" * 32, "two"), ("bb" * 32, "one")):
        cache.get_or_build(sha, name, {}, lambda: spark.range(3))
    before = cache.stats()["entries"]
    cleared = cache.clear("aa" * 32)
    return spark.createDataFrame([(before, cleared, cache.stats()["entries"])], "entries int, cleared int, kept int")


@query(
    "fingerprint_partitions",
    "SELECT 'b' || (c_custkey % 3) AS build_id, count(*) * 2 AS functions FROM customer GROUP BY ALL",
)
def fingerprint_partitions(spark, sf_dir):
    """SNK-01, SRC-21: fingerprints written by build and read back."""
    from cairn.plans.readers import caller

    path = shared_path(spark, "fingerprints")
    found = forge.files(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", caller)
    prints = tables.fingerprints(found).withColumn("build_id", F.concat(F.lit("b"), (F.col("sha256").cast("long") % 3).cast("string")))
    prints.write.partitionBy("build_id").parquet(path)
    return spark.read.parquet(path).groupBy("build_id").agg(F.count(F.lit(1)).alias("functions"))


@query(
    "limited_results",
    "SELECT CAST(5 AS INTEGER) AS shown, 'result_limited' AS code, '5 of ' || (SELECT count(*) FROM supplier) || ' rows' AS detail, 'degraded' AS reliability",
)
def limited_results(spark, sf_dir):
    """TOP-10, EVD-01: a result cut to its limit says how many rows there are."""
    got = limited(table(spark, sf_dir, "supplier").orderBy("s_suppkey"), 5)
    return spark.createDataFrame([(len(got.result), got.warnings[0]["code"], got.warnings[0]["detail"], got.reliability)], "shown int, code string, detail string, reliability string")


@query("clipped_answers", "SELECT true AS fits, 'response_clipped' AS code, 'degraded' AS reliability, true AS whole_rows")
def clipped_answers(spark, sf_dir):
    """SNK-05: an answer that is too long is cut to whole leading rows, and its reliability worked out again."""
    rows = [r.asDict() for r in table(spark, sf_dir, "part").orderBy("p_partkey").limit(200).collect()]
    out = Envelope(rows).to_json(2000)
    got = json.loads(out)
    return spark.createDataFrame([(len(out) <= 2000, got["warnings"][-1]["code"], got["reliability"], got["result"] == rows[: len(got["result"])] and len(got["result"]) > 0)], "fits boolean, code string, reliability string, whole_rows boolean")


@query("guarded_failures", "SELECT * FROM (VALUES ('format', 'format_error'), ('memory', 'out_of_memory'), ('stop', 'aborted'), ('other', 'internal_error')) AS t(failure, error)")
def guarded_failures(spark, sf_dir):
    """EVD-04, SRC-23: every failure becomes a structured answer; a read beyond the end is a format error."""

    @guarded
    def fail(kind):
        if kind == "format":
            managed.parse_class(forge.class_file("demo/A")[:-1])
        raise {"memory": MemoryError, "stop": KeyboardInterrupt}.get(kind, ValueError)("no")

    return spark.createDataFrame([(k, fail(k)["error"]) for k in ("format", "memory", "stop", "other")], "failure string, error string")


@query("truncated_classes", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'format_error' AS code FROM part WHERE p_partkey % 2 = 0")
def truncated_classes(spark, sf_dir):
    """SRC-23, SRC-08: files cut short are refused with a typed error, one row each."""
    found = forge.files(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", lambda k: forge.class_file(f"demo/P{k}")[: None if k % 2 else -(k % 20 + 1)])
    return tables.problems(found, managed.parse_class).select(F.col("sha256").alias("id"), "code")


@query(
    "files_of_a_folder",
    "SELECT '/n' || n_nationkey || '.bin' AS name, CAST(length(n_name) AS BIGINT) AS size, sha256(n_name) AS sha256 FROM nation WHERE length(n_name) BETWEEN 1 AND 8",
)
def files_of_a_folder(spark, sf_dir):
    """SRC-01: the files of a folder that are neither empty nor too large, by content."""
    path = shared_path(spark, "files")
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("value"))
    named.repartition("n").write.partitionBy("n").option("lineSep", "\x00").text(path)
    found = tables.files(spark, path, "part-*", most=9, recursive=True)
    # the sink ends each with a separator; what is told is told of the name before it
    name = F.concat(F.lit("/"), F.lit("n"), F.regexp_extract("path", r"/n=(\d+)/", 1), F.lit(".bin"))
    return found.select(name.alias("name"), (F.col("size") - 1).alias("size"), F.sha2(F.expr("substring(content, 1, size - 1)"), 256).alias("sha256"))


@query(
    "class_by_name",
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS id, 'demo/C0' AS asked, 'demo/C0.class' AS entry FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'D', 'other/D.class' FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'demo.C2', CASE WHEN s_suppkey % 3 = 2 THEN 'demo/C2.class' END FROM supplier
    """,
)
def class_by_name(spark, sf_dir):
    """SRC-14: one class of an archive by its exact name, else by the end of it; the first in the archive's order."""
    found = forge.files(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", forge.jar)
    rows = None
    for asked in ("demo/C0", "D", "demo.C2"):
        one = tables.class_named(found, asked)
        one = found.select("sha256").join(one, "sha256", "left").select(F.col("sha256").alias("id"), F.lit(asked).alias("asked"), "entry")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("first_matching_strings", "SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^SRC1', 'i') ORDER BY doc_id LIMIT 7")
def first_matching_strings(spark, sf_dir):
    """FLT-14, FLT-05, TOP-05: strings that match, in order, as many as asked for."""
    got, warnings = text.matching(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "^SRC1")
    return got.orderBy("doc_id").limit(7) if not warnings else got.limit(0)


@query("invalid_patterns", "SELECT CAST((SELECT count(*) FROM supplier) AS BIGINT) AS rows, 'bad_pattern' AS code")
def invalid_patterns(spark, sf_dir):
    """FLT-03, FLT-05: a pattern that the engine refuses filters nothing and warns."""
    got, warnings = text.matching(table(spark, sf_dir, "supplier"), "s_name", "([a-z")
    return got.agg(F.count(F.lit(1)).alias("rows")).withColumn("code", F.lit(warnings[0]["code"]))


@query(
    "named_functions",
    """
    WITH e AS (SELECT DISTINCT l_suppkey AS s, -1 - l_partkey AS d FROM lineitem), x AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT d, 0, 1 FROM e)
    SELECT node, s_name AS name, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM x JOIN supplier ON s_suppkey = node WHERE s_suppkey % 2 = 0 GROUP BY node, s_name
    """,
)
def named_functions(spark, sf_dir):
    """FLT-08: functions that have a name."""
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    return graph.busiest(calls, names).where("name IS NOT NULL").select("node", "name", (F.col("callees") + F.col("callers")).alias("degree"))


@query("save_stamps", "SELECT s_suppkey AS id, true AS whole_seconds, true AS now FROM supplier")
def save_stamps(spark, sf_dir):
    """DAT-01: the time of a save, in whole seconds."""
    got = policy.stamped(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    return got.select("id", (F.date_trunc("second", "updated") == F.col("updated")).alias("whole_seconds"), (F.abs(F.unix_timestamp("updated") - F.unix_timestamp()) < 3600).alias("now"))


@query(
    "symbol_history",
    """
    WITH r AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events)
    SELECT user_id, event_type, array_to_string(list(event_id ORDER BY ts), ',') AS earlier FROM r WHERE n > 1 GROUP BY user_id, event_type
    """,
)
def symbol_history(spark, sf_dir):
    """KBS-11: all earlier saves of a symbol, in order."""
    saves = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    got = policy.history(saves, ["user_id", "event_type"], ["ts"])
    return got.select("user_id", "event_type", F.array_join(F.transform("history", lambda h: h["event_id"].cast("string")), ",").alias("earlier"))


@query("first_definitions", "SELECT c_nationkey AS name, min(c_custkey) AS first FROM customer GROUP BY c_nationkey")
def first_definitions(spark, sf_dir):
    """FLT-13: of several definitions of a name the first counts."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("name"), F.col("c_custkey").alias("first"))
    return grouping.first_definition(rows, ["name"], ["first"])

