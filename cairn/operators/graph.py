"""Graphs as edge tables: adjacency, degrees, bounded search, closures, dominators, loops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.storage import cut


def adjacency(edges: DataFrame, src: str, dst: str, out: str = "targets") -> DataFrame:
    """Sorted distinct targets of every source."""
    return edges.groupBy(src).agg(F.array_sort(F.collect_set(dst)).alias(out))


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, callees, callers``: numbers of distinct targets and sources, 0 where there are none."""
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    ends = pairs.select(F.col("s").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(pairs.select("d", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("callees"), F.sum("into").alias("callers"))


def busiest(calls: DataFrame, names: DataFrame | None = None, imports: DataFrame | None = None, k: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Functions by degree, greatest first (ties by node): ``node, name, callees, callers, imports_used``.

    ``calls``: ``src, dst``; ``imports``: ``src, name`` of what a function uses;
    ``names``: ``node, name`` and, where several name a node, ``ord`` (the last counts).
    ``starts`` (``node``) lists functions that are to appear without any call, too.
    """
    got = degrees(calls)
    if starts is not None:
        got = starts.select("node").distinct().join(got, "node", "left")
    if imports is None:
        got = got.withColumn("imports_used", F.lit(0).cast("long"))
    else:
        used = imports.groupBy(F.col("src").alias("node")).agg(F.countDistinct("name").alias("imports_used"))
        got = got.join(used, "node", "left")
    got = got.na.fill(0, ["callees", "callers", "imports_used"])
    if names is None:
        got = got.withColumn("name", F.lit(None).cast("string"))
    else:
        last = F.max_by("name", "ord") if "ord" in names.columns else F.max("name")
        got = got.join(names.groupBy("node").agg(last.alias("name")), "node", "left")
    got = got.select("node", "name", "callees", "callers", "imports_used").orderBy(F.desc(F.col("callees") + F.col("callers")), "node")
    return got if k is None else got.limit(k)


def widest(calls: DataFrame, k: int = 25) -> DataFrame:
    """Functions by distinct callees, greatest first (ties by node): ``node, callees``."""
    per = calls.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("callees"))
    return per.orderBy(F.desc("callees"), "node").limit(k)


def summary(sites: DataFrame) -> DataFrame:
    """One row of totals over call sites (``src`` null: in no function; ``dst`` null: indirect; ``kind`` call or import)."""
    direct = F.col("dst").isNotNull()
    pairs = sites.groupBy("kind", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("kind", "src").agg(F.count_if(direct).alias("callees"), F.sum(F.when(direct, F.col("n"))).alias("sites"), F.sum(F.when(~direct, F.col("n"))).alias("indirect"), F.sum("n").alias("all"))
    call, known = F.col("kind") == "call", F.col("src").isNotNull() & (F.col("callees") > 0)

    def total(when, value):
        return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0))

    return per.agg(
        F.count_if(call & known).alias("functions"),
        total(call & known, "callees").alias("edges"),
        F.max(F.when(call & known, F.col("callees"))).alias("widest"),
        total(call & known, "sites").alias("sites"),
        total(call & F.col("src").isNull(), "sites").alias("unattributed"),
        total(call, "indirect").alias("indirect"),
        total(F.col("kind") == "import", "all").alias("import_sites"),
    )


def reach(edges: DataFrame, start: DataFrame, depth: int | None, src: str = "src", dst: str = "dst") -> DataFrame:
    """``origin, node, level``: nodes reached from every ``start`` row (``origin``), at their least level (0 is the start).

    One join and one anti-join per level; each level is written to the shared
    folder, so that plans stay short. ``depth=None`` goes on until nothing is new.
    """
    steps = cut(edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).distinct(), "steps")
    seen = cut(start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("level")).distinct(), "reach")
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        found = front.join(steps, front["node"] == steps["__s"]).select("origin", F.col("__d").alias("node")).distinct()
        front = cut(found.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").select("origin", "node", F.lit(level).alias("level")), "reach")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int = 1, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes within ``depth`` steps of every focus, upwards and downwards apart: ``origin, direction, level, node``."""
    down = reach(edges, focus, depth, src, dst).where("level > 0").withColumn("direction", F.lit("callees"))
    up = reach(edges, focus, depth, dst, src).where("level > 0").withColumn("direction", F.lit("callers"))
    return down.unionByName(up)


def supertypes(parents: DataFrame, names: DataFrame, stop: Column | None = None) -> DataFrame:
    """All supertypes of every name, nearest first: ``origin, node, level``.

    ``parents``: ``name, parent``. ``stop``: names (of ``name``) whose own parents are not followed.
    """
    followed = parents if stop is None else parents.where(~stop)
    return reach(followed, names, None, "name", "parent").where("level > 0")


def blocks(rows: DataFrame, by: list[str], order: list[str], leader: Column) -> DataFrame:
    """``rows`` with ``block``: a running number of leaders (the first row always leads)."""
    w = Window.partitionBy(*by).orderBy(*order)
    lead = F.when((F.row_number().over(w) == 1) | F.coalesce(leader, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("__lead", lead).withColumn("block", F.sum("__lead").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__lead")


def cyclomatic(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges - nodes + 2 of every graph, 0 for one without nodes; rows of both tables are distinct."""
    n = nodes.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("edges"))
    both = n.join(e, by, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return both.withColumn("complexity", F.when(F.col("nodes") > 0, F.col("edges") - F.col("nodes") + 2).otherwise(0))


# ---- one graph per task: control flow graphs are small


def reverse_postorder(nodes: list, succ: dict, entry) -> list:
    """Nodes in reverse postorder from ``entry``; those it does not reach follow in their given order."""
    order, seen, stack = [], {entry}, [(entry, iter(succ.get(entry, ())))]
    while stack:
        node, rest = stack[-1]
        for s in rest:
            if s not in seen:
                seen.add(s)
                stack.append((s, iter(succ.get(s, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    order.reverse()
    return order + [n for n in nodes if n not in seen]


def dominator_sets(nodes: list, succ: dict, entry) -> dict:
    """For every node the set of its dominators; a node that ``entry`` does not reach has itself alone.

    Sets shrink to the intersection over predecessors, in reverse postorder, until nothing changes.
    """
    order = [n for n in reverse_postorder([], succ, entry)]
    pred = {}
    for n in order:
        for s in succ.get(n, ()):
            pred.setdefault(s, []).append(n)
    found = {n: set(order) for n in order}
    found[entry] = {entry}
    changed = True
    while changed:
        changed = False
        for n in order[1:]:
            new = set.intersection(*(found[p] for p in pred[n])) | {n}
            if new != found[n]:
                found[n], changed = new, True
    return {n: found.get(n, {n}) for n in nodes}


def immediate(doms: dict) -> dict:
    """The nearest strict dominator of every node (the one with most dominators), or None."""
    return {n: max((d for d in ds if d != n), key=lambda d: len(doms[d]), default=None) for n, ds in doms.items()}


def _dominates(succ: dict, entry):
    """A test whether a node dominates another, as ``dominator_sets`` has it, without a set for every node (Lengauer and Tarjan)."""
    number, order, parent, stack = {entry: 0}, [entry], [0], [(0, iter(succ.get(entry, ())))]
    while stack:
        v, rest = stack[-1]
        for s in rest:
            if s not in number:
                number[s] = len(order)
                stack.append((len(order), iter(succ.get(s, ()))))
                order.append(s)
                parent.append(v)
                break
        else:
            stack.pop()
    pred, held = [[] for _ in order], [[] for _ in order]
    for v, node in enumerate(order):
        for s in succ.get(node, ()):
            pred[number[s]].append(v)
    semi, label, above, near = list(range(len(order))), list(range(len(order))), [-1] * len(order), [0] * len(order)

    def least(v):
        path, u = [], v
        while above[u] >= 0 and above[above[u]] >= 0:
            path.append(u)
            u = above[u]
        for u in reversed(path):
            up = above[u]
            if semi[label[up]] < semi[label[u]]:
                label[u] = label[up]
            above[u] = above[up]
        return label[v]

    for w in range(len(order) - 1, 0, -1):
        semi[w] = min(semi[least(v)] for v in pred[w])
        held[semi[w]].append(w)
        above[w] = parent[w]
        for v in held[parent[w]]:
            u = least(v)
            near[v] = u if semi[u] < semi[v] else parent[w]
        held[parent[w]] = []
    for w in range(1, len(order)):
        if near[w] != semi[w]:
            near[w] = near[near[w]]
    # places in the tree of dominators: a node's own are one span
    size = [1] * len(order)
    for w in range(len(order) - 1, 0, -1):
        size[near[w]] += size[w]
    at, free = [0] * len(order), [1] * len(order)
    for w in range(1, len(order)):
        at[w] = free[near[w]]
        free[near[w]] += size[w]
        free[w] = at[w] + 1

    def test(a, b):
        if a == b:
            return True
        a, b = number.get(a), number.get(b)
        return a is not None and b is not None and at[a] <= at[b] < at[a] + size[a]

    return test


def _deeper(loops: list[dict]) -> list[int]:
    """For loops of one header, how many of the others hold more than each one's whole body."""
    if len(loops) == 1:
        return [0]
    place, bits = {n: i for i, n in enumerate({n for x in loops for n in x["body"]})}, []
    for x in loops:
        own = bytearray(len(place) // 8 + 1)
        for n in x["body"]:
            own[place[n] >> 3] |= 1 << (place[n] & 7)
        bits.append(int.from_bytes(own, "little"))
    return [sum(x != y and x | y == y for y in bits) for x in bits]


def natural_loops(nodes: list, succ: dict, entry) -> list[dict]:
    """One loop per back edge: header, tail, body and exits, largest body first, then by header.

    Of loops with different headers, one holds all of the other if it holds its
    header, so that only loops of one header are compared by their bodies.
    """
    dominates, pred, out = _dominates(succ, entry), {}, []
    for n in nodes:
        for s in succ.get(n, ()):
            pred.setdefault(s, []).append(n)
    for tail in nodes:
        for head in succ.get(tail, ()):
            if not dominates(head, tail):
                continue
            body, work = {head}, [tail] if tail != head else []
            while work:
                n = work.pop()
                if n not in body:
                    body.add(n)
                    work += pred.get(n, ())
            exits = sorted({s for n in body for s in succ.get(n, ()) if s not in body})
            out.append({"header": head, "tail": tail, "body": sorted(body), "exits": exits})
    out.sort(key=lambda x: (-len(x["body"]), x["header"], x["tail"]))
    same, around = {}, {}
    for x in out:
        same.setdefault(x["header"], []).append(x)
    for x in out:
        for n in x["body"]:
            if n in same and n != x["header"]:
                around[n] = around.get(n, 0) + 1
    for head, group in same.items():
        for x, more in zip(group, _deeper(group)):
            x["depth"] = 1 + around.get(head, 0) + more
    return out


def _graph(pdf: pd.DataFrame):
    nodes = sorted(set(pdf["src"]) | set(pdf["dst"].dropna().astype("int64")))
    succ = {int(s): sorted(int(d) for d in g.dropna().unique()) for s, g in pdf.groupby("src")["dst"]}
    return nodes, succ


def dominators(edges: DataFrame, by: str, entry: str = "entry") -> DataFrame:
    """``by, node, dominators, idom`` for graphs given as ``by, src, dst`` (null: no successor) and ``entry``."""
    def run(pdf):
        nodes, succ = _graph(pdf)
        doms = dominator_sets(nodes, succ, int(pdf[entry].iloc[0]))
        near = immediate(doms)
        return pd.DataFrame([(pdf[by].iloc[0], n, sorted(doms[n]), near[n]) for n in nodes], columns=[by, "node", "dominators", "idom"]).astype({"idom": "Int64"})

    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, "src", "dst", entry).groupBy(by).applyInPandas(run, f"{by} {kind}, node long, dominators array<long>, idom long")


def post_dominators(edges: DataFrame, by: str) -> DataFrame:
    """The same over reversed edges from one common exit behind all nodes without successors."""
    def run(pdf):
        nodes, succ = _graph(pdf)
        back = {-1: [n for n in nodes if not succ.get(n)]}
        for n, targets in succ.items():
            for t in targets:
                back.setdefault(t, []).append(n)
        doms = {n: d - {-1} for n, d in dominator_sets([*nodes, -1], back, -1).items() if n != -1}
        near = immediate(doms)
        return pd.DataFrame([(pdf[by].iloc[0], n, sorted(doms[n]), near[n]) for n in nodes], columns=[by, "node", "dominators", "idom"]).astype({"idom": "Int64"})

    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, "src", "dst").groupBy(by).applyInPandas(run, f"{by} {kind}, node long, dominators array<long>, idom long")


def back_edges(edges: DataFrame, by: str, entry: str = "entry") -> DataFrame:
    """Edges whose head dominates their tail: ``by, tail, header``; a node's edge to itself is one."""
    return loops(edges, by, entry).select(by, "tail", "header")


def rollup(edges: DataFrame, by: str, entry: str = "entry") -> DataFrame:
    """One row a graph: ``nodes, edges, complexity, loops, depth, exits, single_exit`` and its nodes in reverse postorder."""

    def run(pdf):
        nodes, succ = _graph(pdf)
        first = int(pdf[entry].iloc[0])
        found = natural_loops(nodes, succ, first)
        n_edges, exits = sum(map(len, succ.values())), sum(not succ.get(n) for n in nodes)
        row = (pdf[by].iloc[0], len(nodes), n_edges, n_edges - len(nodes) + 2, len(found), max((x["depth"] for x in found), default=0), exits, exits == 1, reverse_postorder(nodes, succ, first))
        return pd.DataFrame([row], columns=[by, "nodes", "edges", "complexity", "loops", "depth", "exits", "single_exit", "order"])

    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, "src", "dst", entry).groupBy(by).applyInPandas(run, f"{by} {kind}, nodes int, edges int, complexity int, loops int, depth int, exits int, single_exit boolean, order array<long>")


def loops(edges: DataFrame, by: str, entry: str = "entry") -> DataFrame:
    """Natural loops of every graph: ``by, header, tail, body, exits, depth``."""
    names = ["header", "tail", "body", "exits", "depth"]

    def run(pdf):
        found = natural_loops(*_graph(pdf), int(pdf[entry].iloc[0]))
        return pd.DataFrame([(pdf[by].iloc[0], *(x[n] for n in names)) for x in found], columns=[by, *names])

    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, "src", "dst", entry).groupBy(by).applyInPandas(run, f"{by} {kind}, header long, tail long, body array<long>, exits array<long>, depth int")
