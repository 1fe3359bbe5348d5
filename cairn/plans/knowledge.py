"""Catalogue, policy and knowledge-base queries (survey ids ALG, KBS, JSN, AGG-17, EVD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import catalog, grouping, policy
from cairn.plans.registry import query
from cairn.session import table

#: A catalogue of license families over documents: name, label, pattern, discriminator.
MARKERS = [
    ("MIT", "title", "mit license", True),
    ("MIT", "shared", "license", False),
    ("Apache", "title", "apache license", True),
    ("Apache", "version", "version 2\\.0", False),
    ("Apache", "shared", "license", False),
    ("GPL", "title", "gnu general public", True),
    ("GPL", "version", "version 3", False),
    ("GPL", "shared", "license", False),
    ("Mail", "address", "[a-z0-9.]+@mail[0-9]+\\.example\\.com", False),
]
MIN_DISTINCT = {"MIT": 2, "Apache": 3, "GPL": 2, "Mail": 1}
DISCRIMINATORS = {n: sum(m[3] for m in MARKERS if m[0] == n) for n in MIN_DISTINCT}
VALUES = ", ".join(f"('{n}', '{label}', '{p}', {str(d).lower()})" for n, label, p, d in MARKERS)
DIMENSION = ", ".join(f"('{n}', {k}, {DISCRIMINATORS[n]})" for n, k in MIN_DISTINCT.items())
HITS_SQL = f"""
    m AS (SELECT * FROM (VALUES {VALUES}) AS v(name, label, pattern, is_discriminator)),
    c AS (SELECT * FROM (VALUES {DIMENSION}) AS v(name, min_distinct, discriminators)),
    hit AS (SELECT d.doc_id, d.source, m.name, m.label, m.is_discriminator FROM documents d JOIN m ON regexp_matches(lower(d.text), m.pattern))
"""


def hits(spark, sf_dir):
    """One row per document and marker: all patterns of a text are tried in one pass over it."""
    low = F.lower("text")
    found = F.array_compact(
        F.array(*[F.when(low.rlike(p), F.struct(F.lit(n).alias("name"), F.lit(label).alias("label"), F.lit(d).alias("is_discriminator"))) for n, label, p, d in MARKERS])
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(found).alias("m")).select("doc_id", "source", "m.*")


@query(
    "marker_catalog_verdict",
    f"""
    WITH {HITS_SQL}, p AS (SELECT source, name, count(DISTINCT label) AS distinct_markers, count(*) AS hits, bool_or(is_discriminator) AS told FROM hit GROUP BY source, name)
    SELECT source, p.name AS name, distinct_markers, hits,
           CASE WHEN distinct_markers >= min_distinct AND (discriminators = 0 OR told) THEN 'identified' ELSE 'lead' END AS verdict,
           CASE WHEN distinct_markers < min_distinct THEN 'too_few' WHEN discriminators > 0 AND NOT told THEN 'no_discriminator' ELSE '' END AS reason
    FROM p JOIN c ON p.name = c.name
    """,
)
def marker_catalog_verdict(spark, sf_dir):
    """ALG-01, AGG-11, TOP-06: what the markers of every source identify."""
    per_source = hits(spark, sf_dir).withColumn("name", F.concat_ws("/", "source", "name"))
    dims = spark.sql(f"SELECT * FROM VALUES {DIMENSION} AS v(family, min_distinct, discriminators)")
    named = per_source.select("name", F.substring_index("name", "/", -1).alias("family")).distinct().join(dims, "family").drop("family")
    got = catalog.verdicts(per_source, named)
    return got.select(F.substring_index("name", "/", 1).alias("source"), F.substring_index("name", "/", -1).alias("name"), "distinct_markers", "hits", "verdict", "reason")


@query(
    "marker_attribution",
    f"""
    WITH {HITS_SQL}, r AS (SELECT name, source, count(*) AS refs FROM hit GROUP BY name, source)
    SELECT name, source, refs, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY refs DESC, source) AS rank FROM r) WHERE rank <= 12
    """,
)
def marker_attribution(spark, sf_dir):
    """ALG-02, JON-10, AGG-12: the twelve sources with most hits of every name."""
    return catalog.attribution(hits(spark, sf_dir), "source", 12).select("name", "source", "refs", "rank")


CLAIM_SQL = """
    c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS DOUBLE) / 10 END AS confidence,
        CASE o_orderkey % 5 WHEN 0 THEN ['string_xref'] WHEN 1 THEN ['symbol_table', 'string_xref'] WHEN 2 THEN ['dynamic_trace', 'import_xref'] WHEN 3 THEN ['made_up', 'structural_guess'] ELSE [] END AS provenance,
        o_orderkey % 3 = 0 AS has_artifact FROM orders),
    k AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 0.4 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN 0.2 END AS cap FROM c JOIN orders ON o_orderkey = id)
"""


@query(
    "policy_evaluate",
    f"""
    WITH {CLAIM_SQL}
    SELECT id, CAST(cap AS DOUBLE) AS cap, array_to_string(list_filter([
        CASE WHEN confidence IS NULL THEN 'confidence_not_numeric' END,
        CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END,
        CASE WHEN len(provenance) = 0 THEN 'no_provenance' END,
        CASE WHEN list_contains(provenance, 'made_up') THEN 'unknown_class' END,
        CASE WHEN confidence > cap THEN 'above_cap' END,
        CASE WHEN confidence > 0.4 AND len(provenance) < 2 THEN 'needs_corroboration' END,
        CASE WHEN list_contains(provenance, 'dynamic_trace') AND NOT has_artifact THEN 'artifact_missing' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM k
    """,
)
def policy_evaluate(spark, sf_dir):
    """KBS-01, KBS-02, AGG-20, JSN-01: every order as a claim under the provenance policy."""
    key = F.col("o_orderkey")
    classes = F.array(
        F.array(F.lit("string_xref")), F.array(F.lit("symbol_table"), F.lit("string_xref")), F.array(F.lit("dynamic_trace"), F.lit("import_xref")), F.array(F.lit("made_up"), F.lit("structural_guess")), F.array().cast("array<string>")
    )
    provenance = F.element_at(classes, (key % 5 + 1).cast("int"))
    artifact = F.when(key % 3 == 0, "trace.bin").otherwise("")
    claims = table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 11 != 0, (key % 13).cast("double") / 10).alias("confidence"),
        provenance.alias("provenance"),
        F.transform(provenance, lambda p: F.struct(p.alias("kind"), artifact.alias("artifact"))).alias("evidence"),
    )
    return policy.evaluate(claims).select("id", "cap", F.array_join("violations", ",").alias("violations"))


@query(
    "kb_upsert_history",
    """
    WITH r AS (SELECT user_id, event_type, event_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS total,
                      lead(value) OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS before FROM events)
    SELECT user_id, event_type, event_id, value AS confidence, total - 1 AS revisions, before AS previous_confidence, coalesce(value < before, false) AS downgraded FROM r WHERE n = 1
    """,
)
def kb_upsert_history(spark, sf_dir):
    """KBS-11: events as saves of a symbol: the last one, how many came before, the last confidence."""
    saves = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.col("value").alias("confidence"))
    got = policy.revisions(saves, ["user_id", "event_type"], ["ts"])
    return got.select("user_id", "event_type", "event_id", "confidence", "revisions", "previous_confidence", "downgraded")


@query(
    "kb_lookup",
    "SELECT event_id, event_type AS name, value AS confidence FROM events WHERE coalesce(value, 0) >= 20 AND contains(lower(event_type), 'pur') ORDER BY confidence DESC, name, event_id",
)
def kb_lookup(spark, sf_dir):
    """KBS-12, FLT-09, TOP-08: by part of the name and least confidence, best first."""
    symbols = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.col("value").alias("confidence"))
    return policy.lookup(symbols, "PUR", min_confidence=20, columns=("name",)).orderBy(F.desc("confidence"), "name", "event_id")


@query(
    "verify_site_interval",
    """
    SELECT c.event_id AS event_id, EXISTS (SELECT 1 FROM events s WHERE s.user_id = c.user_id AND s.event_type = 'error' AND s.event_id >= c.event_id AND s.event_id < c.event_id + 200) AS verified
    FROM events c WHERE c.event_type = 'purchase'
    """,
)
def verify_site_interval(spark, sf_dir):
    """JON-13: whether any site of the claim's image lies in its extent."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    claims = events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("low"), (F.col("event_id") + 200).alias("high"))
    sites = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("site"))
    return policy.verify_site(claims, sites, ["user_id"], "low", "high", "site", width=5000.0).select("event_id", "verified")


#: Orders as claims about functions: order k of customer u is the function at address k of image u, 100 long; line items are its sites.
FUNCTION = ["o_orderkey AS claim", "CAST(o_custkey % 50 AS STRING) AS sha256", "o_orderkey AS va", "o_orderkey AS low", "o_orderkey + 100 AS high"]
EVIDENCE = {
    "string_xref": "concat('s', o_orderkey % 7) AS string",
    "import_xref": "IF(o_orderkey % 4 = 0, '', concat('FUN', o_orderkey % 9)) AS import",
    "constant_xref": "IF(o_orderkey % 5 = 0, NULL, o_orderkey % 11) AS constant",
    "callgraph_position": "o_orderkey + 3 AS calls, IF(o_orderkey % 2 = 0, o_orderkey + 5, NULL) AS called_by",
    "cross_build_match": "CAST(o_orderkey % 10 AS DOUBLE) / 10 AS score, CAST(o_orderkey % 4 AS INT) AS agreeing, concat('b', o_orderkey % 3) AS matched_build",
}


def function_claims(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*FUNCTION, *[e for v in EVIDENCE.values() for e in _expressions(v)])


def _expressions(text: str) -> list[str]:
    """Comma-separated ``expression AS name`` items (commas inside parentheses belong to an item)."""
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item.strip())
            item = ""
        else:
            item += c
    return [*out, item.strip()]


def claim_sites(spark, sf_dir):
    """References (``sha256, site, target``): line l of order k refers from k + 10 l to target (part % 40) of the image."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.selectExpr("CAST(o_custkey % 50 AS STRING) AS sha256", "o_orderkey + 10 * l_linenumber AS site", "l_partkey % 40 AS target", "concat('lib!Fun', l_suppkey % 9, '_') AS qualified", "l_linenumber")


CLAIMS_SQL = """
    c AS (SELECT o_orderkey AS claim, o_custkey % 50 AS img, o_orderkey AS va, o_orderkey AS low, o_orderkey + 100 AS high FROM orders),
    r AS (SELECT o_custkey % 50 AS img, o_orderkey + 10 * l_linenumber AS site, l_partkey % 40 AS target, 'lib!Fun' || (l_suppkey % 9) || '_' AS qualified, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


@query(
    "verify_string_xref",
    f"WITH {CLAIMS_SQL} SELECT DISTINCT claim FROM c JOIN r ON r.img = c.img AND site >= low AND site < high WHERE target < 14 AND target % 7 = claim % 7",
)
def verify_string_xref(spark, sf_dir):
    """KBS-03, JON-13: a reference in the extent to a place of the claimed string; strings s0 to s6 stand at targets 0 to 13."""
    claims, refs = function_claims(spark, sf_dir), claim_sites(spark, sf_dir)
    places = spark.range(50).selectExpr("CAST(id AS STRING) AS sha256", "explode(sequence(0L, 13L)) AS va").selectExpr("sha256", "va", "concat('s', va % 7) AS string")
    return policy.verify_string_xref(claims, places, refs)


@query(
    "verify_import_xref",
    f"""
    WITH {CLAIMS_SQL} SELECT DISTINCT claim FROM c JOIN r ON r.img = c.img AND site >= low AND site < high
    WHERE claim % 4 <> 0 AND ((l_linenumber = 1 AND contains(lower(qualified), 'fun' || (claim % 9))) OR (target >= 30 AND (target - 30) = claim % 9))
    """,
)
def verify_import_xref(spark, sf_dir):
    """KBS-04: a call of the claimed import in the extent, or a reference to its slot; imports Fun0 to Fun8 have slots 30 to 38."""
    refs = claim_sites(spark, sf_dir)
    slots = spark.range(50).selectExpr("CAST(id AS STRING) AS sha256", "explode(sequence(30L, 38L)) AS slot").selectExpr("sha256", "slot", "concat('lib!Fun', slot - 30, '_') AS qualified")
    return policy.verify_import_xref(function_claims(spark, sf_dir), refs.where("l_linenumber = 1").select("sha256", "site", "qualified"), slots, refs)


@query(
    "verify_constant_xref",
    "SELECT DISTINCT o_orderkey AS claim FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 AND l_partkey % 11 = o_orderkey % 11",
)
def verify_constant_xref(spark, sf_dir):
    """KBS-05: the claimed constant is one of the function's."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    prints = lines.groupBy(F.expr("CAST(o_custkey % 50 AS STRING)").alias("sha256"), F.col("o_orderkey").alias("va")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 11)).alias("constants"))
    return policy.verify_constant_xref(function_claims(spark, sf_dir), prints)


@query(
    "verify_callgraph_position",
    """
    WITH c AS (SELECT o_orderkey AS k, o_custkey % 50 AS img FROM orders)
    SELECT k AS claim FROM c WHERE EXISTS (SELECT 1 FROM c e WHERE e.img = c.img AND e.k = c.k AND e.k % 3 = 0) OR (k % 2 = 0 AND EXISTS (SELECT 1 FROM c e WHERE e.img = c.img AND e.k = c.k + 5 AND e.k % 3 = 1))
    """,
)
def verify_callgraph_position(spark, sf_dir):
    """KBS-06: the function calls, or is called by, the claimed peer."""
    orders = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey % 50 AS STRING) AS sha256", "o_orderkey AS k")
    calls = orders.where("k % 3 = 0").selectExpr("sha256", "k AS src", "k + 3 AS dst").unionByName(orders.where("k % 3 = 1").selectExpr("sha256", "k AS src", "k - 5 AS dst"))
    return policy.verify_callgraph_position(function_claims(spark, sf_dir), calls)


@query(
    "verify_symbols_and_exports",
    "SELECT o_orderkey AS claim, 'symbol_table' AS class FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'export_table' FROM orders WHERE o_orderkey % 10 = 0",
)
def verify_symbols_and_exports(spark, sf_dir):
    """KBS-07, KBS-08: a symbol, or an export, at the claimed address."""
    orders = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey % 50 AS STRING) AS sha256", "o_orderkey AS va")
    claims = function_claims(spark, sf_dir)
    named = policy.verify_named(claims, orders.where("va % 6 = 0")).withColumn("class", F.lit("symbol_table"))
    return named.unionByName(policy.verify_named(claims, orders.where("va % 10 = 0")).withColumn("class", F.lit("export_table")))


@query(
    "verify_cross_build_match",
    "SELECT o_orderkey AS claim FROM orders WHERE CAST(o_orderkey % 10 AS DOUBLE) / 10 >= 0.55 AND o_orderkey % 4 >= 2 AND o_orderkey % 3 = 1 AND o_orderkey % 7 < 5",
)
def verify_cross_build_match(spark, sf_dir):
    """KBS-09: the claimed match reaches the thresholds, and a stored match says the same."""
    stored = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 1").selectExpr("o_orderkey AS va", "'b1' AS matched_build", "IF(o_orderkey % 7 < 5, 0.9D, 0.1D) AS score")
    return policy.verify_cross_build_match(function_claims(spark, sf_dir), stored)


@query(
    "verified_policy",
    """
    WITH k AS (SELECT o_orderkey AS id, o_orderkey % 6 = 0 AS symbol, o_orderkey % 10 = 0 AS export, CASE o_orderkey % 4 WHEN 0 THEN ['symbol_table'] WHEN 1 THEN ['symbol_table', 'export_table'] WHEN 2 THEN ['structural_guess'] ELSE ['export_table', 'community_source'] END AS classes FROM orders)
    SELECT id, array_to_string(list_sort(list_filter([CASE WHEN export THEN 'export_table' END, CASE WHEN symbol THEN 'symbol_table' END], lambda x: x IS NOT NULL)), ',') AS verified,
           array_to_string(list_filter([CASE WHEN (list_contains(classes, 'symbol_table') AND NOT symbol) OR (list_contains(classes, 'export_table') AND NOT export) THEN 'not_verified' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM k
    """,
)
def verified_policy(spark, sf_dir):
    """KBS-02, KBS-03b: claims with what their image bears out, and the rules they break with it."""
    claims = function_claims(spark, sf_dir)
    symbols = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey % 50 AS STRING) AS sha256", "o_orderkey AS va")
    found = {"symbol_table": policy.verify_named(claims, symbols.where("va % 6 = 0")), "export_table": policy.verify_named(claims, symbols.where("va % 10 = 0"))}
    marked = policy.verified_classes(claims, found).selectExpr(
        "claim AS id", "verified", "0.2D AS confidence",
        "element_at(array(array('symbol_table'), array('symbol_table', 'export_table'), array('structural_guess'), array('export_table', 'community_source')), CAST(claim % 4 + 1 AS INT)) AS provenance",
    )
    marked = marked.withColumn("evidence", F.transform("provenance", lambda p: F.struct(p.alias("kind"), F.lit("").alias("artifact"))))
    return policy.evaluate(marked, "verified").select("id", F.array_join("verified", ",").alias("verified"), F.array_join("violations", ",").alias("violations"))


@query(
    "register_builds",
    """
    WITH new AS (SELECT 'b' || s_suppkey AS build_id, 'sha' || (s_suppkey % 4) AS sha256 FROM supplier), known AS (SELECT 'b' || s_suppkey AS build_id, 'sha' || (s_suppkey % 2) AS sha256 FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT build_id, sha256, 'kept' AS state FROM known
    UNION ALL SELECT n.build_id, n.sha256, CASE WHEN k.build_id IS NULL THEN 'kept' ELSE 'rejected' END FROM new n LEFT JOIN known k ON n.build_id = k.build_id WHERE k.build_id IS NULL OR k.sha256 <> n.sha256
    """,
)
def register_builds(spark, sf_dir):
    """KBS-10: new builds are kept unless their id is known with another content."""
    build = lambda n: ["concat('b', s_suppkey) AS build_id", f"concat('sha', s_suppkey % {n}) AS sha256"]
    suppliers = table(spark, sf_dir, "supplier")
    kept, rejected = policy.register_builds(suppliers.where("s_suppkey % 3 = 0").selectExpr(*build(2)), suppliers.selectExpr(*build(4)))
    return kept.withColumn("state", F.lit("kept")).unionByName(rejected.withColumn("state", F.lit("rejected")))


@query("policy_document", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({cap} AS DOUBLE), {str(v).lower()}, {str(a).lower()})" for n, cap, v, a in policy.PROVENANCE) + ") AS p(name, cap, verifiable, requires_artifact)")
def policy_document(spark, sf_dir):
    """KBS-01: the policy as a table."""
    return policy.document(spark)


@query(
    "evidence_json",
    """
    WITH e AS (SELECT user_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events)
    SELECT user_id, kind, k FROM e WHERE n = 1
    """,
)
def evidence_json(spark, sf_dir):
    """JSN-01, SET-06: free-form evidence, the last object of every kind counts."""
    entry = F.struct("ts", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"))
    return lists.select("user_id", F.explode(policy.last_of_kind(F.col("evidence"))).alias("e")).select("user_id", "e.kind", "e.k")


@query(
    "reliability_rollup",
    """
    WITH r AS (SELECT source, CASE WHEN n_chars < 100 THEN 2 WHEN n_chars < 500 THEN 1 ELSE 0 END AS rank FROM documents)
    SELECT source, list_element(['sound', 'degraded', 'unreliable'], max(rank) + 1) AS reliability, count(*) FILTER (WHERE rank > 0) AS warnings FROM r GROUP BY source
    """,
)
def reliability_rollup(spark, sf_dir):
    """AGG-17, EVD-01: the worst impact of a source's warnings."""
    rank = F.when(F.col("n_chars") < 100, 2).when(F.col("n_chars") < 500, 1).otherwise(0)
    rows = table(spark, sf_dir, "documents").select("source", rank.alias("rank"))
    worst = grouping.worst(rows, ["source"], F.col("rank"), "worst")
    warned = rows.groupBy("source").agg(F.count_if(F.col("rank") > 0).alias("warnings"))
    names = F.array(F.lit("sound"), F.lit("degraded"), F.lit("unreliable"))
    return worst.join(warned, "source").select("source", F.element_at(names, F.col("worst") + 1).alias("reliability"), "warnings")
