"""Group and graph queries (survey ids AGG, TOP, GRF)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import graph, grouping
from cairn.plans.registry import query
from cairn.session import table


def calls(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


@query(
    "degree_topk",
    """
    WITH e AS (SELECT DISTINCT l_suppkey AS s, -1 - l_partkey AS d FROM lineitem),
         x AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT d, 0, 1 FROM e),
         d AS (SELECT node, sum(o) AS callees, sum(i) AS callers FROM x GROUP BY node),
         u AS (SELECT l_suppkey AS node, count(DISTINCT l_returnflag) AS imports_used FROM lineitem GROUP BY l_suppkey)
    SELECT d.node AS node, s.s_name AS name, CAST(callees AS BIGINT) AS callees, CAST(callers AS BIGINT) AS callers, coalesce(imports_used, 0) AS imports_used
    FROM d LEFT JOIN u ON u.node = d.node LEFT JOIN supplier s ON s.s_suppkey = d.node ORDER BY callees + callers DESC, d.node LIMIT 25
    """,
)
def degree_topk(spark, sf_dir):
    """AGG-05, TOP-01, JON-02: functions by degree, with the imports they use and the last of their names."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    names = names.withColumn("ord", F.lit(1)).unionByName(names.withColumn("name", F.concat(F.lit("old "), "name")).withColumn("ord", F.lit(0)))
    imports = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("name"))
    return graph.busiest(calls(spark, sf_dir).withColumn("dst", -1 - F.col("dst")), names, imports, 25)


@query("widest_functions", "SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS callees FROM lineitem GROUP BY l_suppkey ORDER BY callees DESC, node LIMIT 25")
def widest_functions(spark, sf_dir):
    """TOP-02: the 25 functions with most distinct callees."""
    return graph.widest(calls(spark, sf_dir))


@query(
    "adjacency_sets",
    "SELECT l_suppkey AS src, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS targets FROM lineitem GROUP BY l_suppkey",
)
def adjacency_sets(spark, sf_dir):
    """AGG-04, ARR-01: sorted distinct targets of every source."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.concat("l_returnflag", "l_linestatus").alias("dst"))
    return graph.adjacency(edges, "src", "dst").select("src", F.array_join("targets", ",").alias("targets"))


@query(
    "node_degrees",
    """
    WITH e AS (SELECT DISTINCT l_suppkey AS s, -1 - l_partkey AS d FROM lineitem),
         x AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT d, 0, 1 FROM e)
    SELECT node, CAST(sum(o) AS BIGINT) AS callees, CAST(sum(i) AS BIGINT) AS callers FROM x GROUP BY node
    """,
)
def node_degrees(spark, sf_dir):
    """AGG-05: distinct callees and callers of every node, 0 where there are none."""
    return graph.degrees(calls(spark, sf_dir).withColumn("dst", -1 - F.col("dst")))


SITE_SQL = """
    s AS (SELECT CASE WHEN l_quantity = 1 THEN NULL ELSE l_suppkey END AS src, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_partkey END AS dst, CASE WHEN l_linenumber = 1 THEN 'import' ELSE 'call' END AS kind FROM lineitem)
"""


@query(
    "graph_summary",
    f"""
    WITH {SITE_SQL}, e AS (SELECT DISTINCT src, dst FROM s WHERE kind = 'call' AND src IS NOT NULL AND dst IS NOT NULL), o AS (SELECT src, count(*) AS n FROM e GROUP BY src)
    SELECT (SELECT count(*) FROM o) AS functions, CAST((SELECT count(*) FROM e) AS BIGINT) AS edges, (SELECT max(n) FROM o) AS widest,
           (SELECT count(*) FROM s WHERE kind = 'call' AND src IS NOT NULL AND dst IS NOT NULL) AS sites, (SELECT count(*) FROM s WHERE kind = 'call' AND src IS NULL AND dst IS NOT NULL) AS unattributed,
           (SELECT count(*) FROM s WHERE kind = 'call' AND dst IS NULL) AS indirect, (SELECT count(*) FROM s WHERE kind = 'import') AS import_sites
    """,
)
def graph_summary(spark, sf_dir):
    """AGG-06: one row of totals over call sites, some of them in no function, indirect or of imports."""
    sites = table(spark, sf_dir, "lineitem").selectExpr("IF(l_quantity = 1, NULL, l_suppkey) AS src", "IF(l_linenumber = 2, NULL, l_partkey) AS dst", "IF(l_linenumber = 1, 'import', 'call') AS kind")
    return graph.summary(sites)


CAPPED = "l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice"


@query(
    "capped_xrefs",
    f"""
    WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {CAPPED}) AS seq, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem)
    SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, CAST(seq AS INTEGER) AS seq, total, greatest(total - 5, 0) AS overflow FROM r WHERE seq <= 5
    """,
)
def capped_xrefs(spark, sf_dir):
    """AGG-02, AGG-03, XRF-01, WIN-03: the first five sites of every target, with exact overflow."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", *CAPPED.split(", "))
    return grouping.capped(rows, ["l_partkey"], CAPPED.split(", "), 5).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "seq", "total", "overflow")


def layers(spark, sf_dir):
    """Region to nation to supplier to part, as one edge table of text nodes."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = [
        table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")),
        table(spark, sf_dir, "supplier").select(name("n", "s_nationkey"), name("s", "s_suppkey")),
        table(spark, sf_dir, "lineitem").select(name("s", "l_suppkey"), name("p", "l_partkey")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "khop_neighbourhood",
    """
    WITH RECURSIVE e AS (
        SELECT DISTINCT * FROM (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
        UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
        UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)),
    f AS (SELECT 'n' || n_nationkey AS origin FROM nation),
    down AS (SELECT origin, origin AS node, 0 AS level FROM f UNION SELECT d.origin, e.dst, d.level + 1 FROM down d JOIN e ON e.src = d.node WHERE d.level < 2),
    up AS (SELECT origin, origin AS node, 0 AS level FROM f UNION SELECT d.origin, e.src, d.level + 1 FROM up d JOIN e ON e.dst = d.node WHERE d.level < 2),
    b AS (SELECT origin, node, 'callees' AS direction, min(level) AS level FROM down GROUP BY origin, node UNION ALL SELECT origin, node, 'callers', min(level) FROM up GROUP BY origin, node)
    SELECT origin, direction, CAST(level AS INTEGER) AS level, count(*) AS nodes, min(node) AS first_node FROM b WHERE level > 0 GROUP BY origin, direction, level
    """,
)
def khop_neighbourhood(spark, sf_dir):
    """GRF-01: two steps up and down from every nation, by level."""
    focus = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("origin"))
    got = graph.neighbourhood(layers(spark, sf_dir), focus, 2)
    return got.groupBy("origin", "direction", "level").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first_node"))


@query(
    "supertype_closure",
    """
    SELECT n_name AS origin, r_name AS node, 1 AS level FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, 'ROOT', 2 FROM nation UNION ALL SELECT r_name, 'ROOT', 1 FROM region
    """,
)
def supertype_closure(spark, sf_dir):
    """GRF-02: all supertypes, nearest first; nations extend regions, regions the root."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    parents = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    parents = parents.unionAll(region.select("r_name", F.lit("ROOT")))
    return graph.supertypes(parents, parents.select(F.col("name").alias("origin"))).select("origin", "node", "level")


@query(
    "event_cfg_blocks",
    """
    WITH l AS (SELECT user_id, event_id, ts, CASE WHEN row_number() OVER w = 1 OR event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS lead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, event_id, CAST(sum(lead) OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS block FROM l
    """,
)
def event_cfg_blocks(spark, sf_dir):
    """GRF-07, GRF-08: basic blocks from leaders, as a running number."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return graph.blocks(events, ["user_id"], ["ts"], F.col("event_type").isin("error", "purchase")).select("user_id", "event_id", "block")


def transitions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return turns.withColumn("next", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))


@query(
    "cyclomatic_per_conversation",
    """
    WITH t AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
         n AS (SELECT conv_id, count(DISTINCT role) AS nodes FROM t GROUP BY conv_id),
         e AS (SELECT conv_id, count(*) AS edges FROM (SELECT DISTINCT conv_id, role, next FROM t WHERE next IS NOT NULL) GROUP BY conv_id)
    SELECT n.conv_id AS conv_id, nodes, coalesce(edges, 0) AS edges, coalesce(edges, 0) - nodes + 2 AS complexity FROM n LEFT JOIN e ON n.conv_id = e.conv_id
    """,
)
def cyclomatic_per_conversation(spark, sf_dir):
    """AGG-15, AGG-16: edges minus nodes plus two, of role transitions."""
    t = transitions(spark, sf_dir)
    return graph.cyclomatic(t.select("conv_id", "role"), t.where("next IS NOT NULL").select("conv_id", "role", "next"), ["conv_id"])


@query(
    "back_edges_self_loops",
    """
    WITH t AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events)
    SELECT DISTINCT user_id, event_type FROM t WHERE next = event_type
    """,
)
def back_edges_self_loops(spark, sf_dir):
    """GRF-05: back edges of every user's graph of event types; those from a node to itself."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    names = ["click", "error", "login", "purchase", "view", "search", "logout", "signup"]
    code = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("event_type")), F.lit(0)).cast("long")
    w = Window.partitionBy("user_id").orderBy("ts")
    coded = events.withColumn("src", code).withColumn("dst", F.lead("src").over(w)).withColumn("entry", F.first("src").over(w))
    found = graph.back_edges(coded.select("user_id", "src", "dst", "entry").distinct(), "user_id").where("tail = header").distinct()
    return found.select("user_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("header").cast("int")).alias("event_type"))


ROLES = {"system": 0, "user": 1, "assistant": 2}


def role_edges(spark, sf_dir):
    t = transitions(spark, sf_dir)
    code = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    first = F.min(F.struct("turn", "role")).over(Window.partitionBy("conv_id"))["role"]
    return t.select("conv_id", F.element_at(code, F.col("role")).cast("long").alias("src"), F.element_at(code, F.col("next")).cast("long").alias("dst"), F.element_at(code, first).cast("long").alias("entry"))


@query(
    "natural_loops",
    """
    WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations),
         e AS (SELECT DISTINCT conv_id, role AS src, next AS dst, entry FROM t WHERE next IS NOT NULL),
         -- with three nodes a node h dominates t iff t cannot be reached from the entry without h
         bans AS (SELECT DISTINCT conv_id, entry, dst AS h FROM e),
         r0 AS (SELECT conv_id, h, entry AS node FROM bans WHERE entry <> h),
         r1 AS (SELECT r0.conv_id, r0.h, e.dst AS node FROM r0 JOIN e ON e.conv_id = r0.conv_id AND e.src = r0.node AND e.dst <> r0.h UNION SELECT * FROM r0),
         r2 AS (SELECT r1.conv_id, r1.h, e.dst AS node FROM r1 JOIN e ON e.conv_id = r1.conv_id AND e.src = r1.node AND e.dst <> r1.h UNION SELECT * FROM r1),
         back AS (SELECT e.conv_id, e.src AS tail, e.dst AS header FROM e WHERE NOT EXISTS (SELECT 1 FROM r2 WHERE r2.conv_id = e.conv_id AND r2.h = e.dst AND r2.node = e.src))
    SELECT conv_id, count(*) AS loops, count(DISTINCT header) AS headers FROM back GROUP BY conv_id
    """,
)
def natural_loops(spark, sf_dir):
    """GRF-03, GRF-05, GRF-06: loops of every conversation's role graph (dominators in one task per graph)."""
    found = graph.loops(role_edges(spark, sf_dir), "conv_id")
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("loops"), F.countDistinct("header").alias("headers"))


LOOPS_SQL = """
    t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations),
    e AS (SELECT DISTINCT conv_id, role AS src, next AS dst, entry FROM t WHERE next IS NOT NULL),
    nodes AS (SELECT DISTINCT conv_id, role AS node, entry FROM t),
    bans AS (SELECT conv_id, entry, node AS h FROM nodes),
    r0 AS (SELECT conv_id, h, entry AS node FROM bans WHERE entry <> h),
    r1 AS (SELECT r0.conv_id, r0.h, e.dst AS node FROM r0 JOIN e ON e.conv_id = r0.conv_id AND e.src = r0.node AND e.dst <> r0.h UNION SELECT * FROM r0),
    r2 AS (SELECT r1.conv_id, r1.h, e.dst AS node FROM r1 JOIN e ON e.conv_id = r1.conv_id AND e.src = r1.node AND e.dst <> r1.h UNION SELECT * FROM r1),
    dom AS (SELECT n.conv_id, n.node, b.h FROM nodes n JOIN bans b ON b.conv_id = n.conv_id WHERE b.h = n.node OR NOT EXISTS (SELECT 1 FROM r2 WHERE r2.conv_id = n.conv_id AND r2.h = b.h AND r2.node = n.node))
"""
CODE_SQL = "CASE {0} WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END"


@query(
    "dominator_sets",
    f"WITH {LOOPS_SQL} SELECT conv_id, CAST({CODE_SQL.format('node')} AS BIGINT) AS node, array_to_string(list_sort(list({CODE_SQL.format('h')})), ',') AS dominators FROM dom GROUP BY conv_id, node",
)
def dominator_sets(spark, sf_dir):
    """GRF-03, SET-04: every role's dominators in its conversation's graph."""
    return graph.dominators(role_edges(spark, sf_dir), "conv_id").select("conv_id", "node", F.array_join("dominators", ",").alias("dominators"))


@query(
    "post_dominators",
    """
    WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, i AS node, CASE WHEN i < n - 1 THEN i + 1 END AS nearest, n - i AS size FROM n WHERE n <= 120
    """,
)
def post_dominators(spark, sf_dir):
    """GRF-04: every event of a short history is post-dominated by all that follow; the next one is nearest."""
    w = Window.partitionBy("user_id").orderBy("ts")
    events = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("src"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    edges = events.where("n <= 120").select("user_id", "src", F.when(F.col("src") < F.col("n") - 1, F.col("src") + 1).alias("dst"))
    got = graph.post_dominators(edges, "user_id")
    return got.select("user_id", "node", F.col("idom").alias("nearest"), F.size("dominators").cast("long").alias("size"))


@query(
    "loop_bodies",
    """
    WITH u AS (SELECT user_id, count(*) % 7 + 2 AS n FROM events GROUP BY user_id), o AS (SELECT user_id, n, unnest([0, 1]) AS k FROM u)
    SELECT user_id, CAST(k AS BIGINT) AS header, n - k AS tail, n - 2 * k + 1 AS size, CAST(CASE WHEN k = 0 THEN 0 ELSE 1 END AS BIGINT) AS exits, CAST(k + 1 AS INTEGER) AS depth FROM o WHERE k = 0 OR n > 2
    """,
)
def loop_bodies(spark, sf_dir):
    """GRF-06, TOP-09, SET-05: two nested loops over a path of nodes: bodies, exits and depth, the larger first."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count(F.lit(1)) % 7 + 2).alias("n"))
    # nodes 0..n in a path; n goes back to 0, and n - 1 to 1 (once there is room)
    path = users.select("user_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("src")).select("user_id", "src", (F.col("src") + 1).alias("dst"))
    back = users.select("user_id", F.col("n").alias("src"), F.lit(0).cast("long").alias("dst"))
    inner = users.where("n > 2").select("user_id", (F.col("n") - 1).alias("src"), F.lit(1).cast("long").alias("dst"))
    edges = path.unionByName(back).unionByName(inner).withColumn("entry", F.lit(0).cast("long"))
    found = graph.loops(edges, "user_id")
    return found.select("user_id", "header", "tail", F.size("body").cast("long").alias("size"), F.size("exits").cast("long").alias("exits"), "depth")


@query(
    "graph_rollup",
    """
    WITH u AS (SELECT user_id, count(*) % 7 + 2 AS n FROM events GROUP BY user_id)
    SELECT user_id, CAST(n + 2 AS INTEGER) AS nodes, CAST(n + 2 AS INTEGER) AS edges, CAST(2 AS INTEGER) AS complexity, CAST(1 AS INTEGER) AS loops, CAST(1 AS INTEGER) AS depth, CAST(1 AS INTEGER) AS exits, true AS single_exit,
           '0,' || array_to_string(list_concat([n + 1], range(1, n + 1)), ',') AS visited FROM u
    """,
)
def graph_rollup(spark, sf_dir):
    """AGG-16, GRF-09: blocks, edges, loops, exits, and the nodes in reverse postorder: a ring with one way out."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count(F.lit(1)) % 7 + 2).alias("n"))
    ring = users.select("user_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("src"))
    ring = ring.select("user_id", "src", F.when(F.col("src") < F.col("n"), F.col("src") + 1).otherwise(0).alias("dst"))
    out = users.select("user_id", F.lit(0).cast("long").alias("src"), (F.col("n") + 1).alias("dst"))
    got = graph.rollup(ring.unionByName(out).withColumn("entry", F.lit(0).cast("long")), "user_id")
    return got.select("user_id", "nodes", "edges", "complexity", "loops", "depth", "exits", "single_exit", F.array_join("order", ",").alias("visited"))
