"""Claims under a provenance policy, and the knowledge base they are kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.asof import next_join

#: Class, cap on confidence, verifiable, needs an artifact.
PROVENANCE = [
    ("structural_guess", 0.20, False, False),
    ("string_xref", 0.40, True, False),
    ("import_xref", 0.40, True, False),
    ("constant_xref", 0.40, True, False),
    ("callgraph_position", 0.40, True, False),
    ("cross_build_match", 0.60, True, False),
    ("community_source", 0.60, False, False),
    ("symbol_table", 0.95, True, False),
    ("export_table", 0.95, True, False),
    ("dynamic_trace", 0.80, False, True),
    ("experimental_manipulation", 0.95, False, True),
    ("authoritative_source", 1.00, False, True),
]
#: Above this confidence a claim needs so many classes.
CORROBORATE_ABOVE, CORROBORATE_WITH = 0.40, 2


def document(spark: SparkSession) -> DataFrame:
    """The policy as a table."""
    values = ", ".join(f"('{n}', {cap}D, {str(v).lower()}, {str(a).lower()})" for n, cap, v, a in PROVENANCE)
    return spark.sql(f"SELECT * FROM VALUES {values} AS p(name, cap, verifiable, requires_artifact)")


def _caps(classes: Column) -> Column:
    caps = F.create_map(*[F.lit(x) for n, cap, _, _ in PROVENANCE for x in (n, cap)])
    return F.array_max(F.transform(classes, lambda c: F.element_at(caps, c)))


def last_of_kind(evidence: Column) -> Column:
    """The entries of an evidence array after which no other of their kind comes: the last of every kind counts."""
    later = lambda e, i: F.exists(F.slice(evidence, i + 2, F.greatest(F.size(evidence), F.lit(1))), lambda x: x["kind"].eqNullSafe(e["kind"]))
    return F.filter(evidence, lambda e, i: ~later(e, i))


def evaluate(claims: DataFrame, verified: str | None = None) -> DataFrame:
    """``claims`` with ``cap``, ``violations`` (in the order of the rules) and ``accepted``.

    ``claims``: ``confidence`` (double), ``provenance`` (array), ``evidence``
    (array of structs with ``kind`` and ``artifact``; of a kind the last entry
    counts). ``verified`` names an array column of the classes whose evidence a
    verifier has confirmed (see ``verified_classes``); without it nothing is asked
    of verifiers.
    """
    known = F.array(*[F.lit(n) for n, *_ in PROVENANCE])
    need_artifact = F.array(*[F.lit(n) for n, _, _, a in PROVENANCE if a])
    checkable = F.array(*[F.lit(n) for n, _, v, _ in PROVENANCE if v])
    classes = F.array_distinct(F.coalesce("provenance", F.array().cast("array<string>")))
    kinds = F.transform(F.coalesce(F.col("evidence"), F.array().cast(claims.schema["evidence"].dataType)), lambda e: e["kind"])
    proven = F.transform(F.filter(last_of_kind(F.col("evidence")), lambda e: F.coalesce(F.length(F.trim(e["artifact"])) > 0, F.lit(False))), lambda e: e["kind"])
    c = F.col("confidence")
    cap = _caps(F.array_intersect(classes, known))
    rules = [
        (c.isNull() | F.isnan(c), "confidence_not_numeric"),
        ((c < 0) | (c > 1), "confidence_out_of_range"),
        (F.size(classes) == 0, "no_provenance"),
        (F.size(F.array_except(classes, known)) > 0, "unknown_class"),
        (c > cap, "above_cap"),
        ((c > CORROBORATE_ABOVE) & (F.size(classes) < CORROBORATE_WITH), "needs_corroboration"),
        (F.exists(kinds, lambda k: k.isNull()), "evidence_without_kind"),
        (F.size(F.array_except(F.array_intersect(classes, need_artifact), F.coalesce(proven, F.array().cast("array<string>")))) > 0, "artifact_missing"),
    ]
    if verified:
        rules.append((F.size(F.array_except(F.array_intersect(classes, checkable), F.coalesce(verified, F.array().cast("array<string>")))) > 0, "not_verified"))
    out = F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in rules]))
    return claims.withColumns({"cap": cap, "violations": out}).withColumn("accepted", F.size("violations") == 0)


def verify_site(claims: DataFrame, sites: DataFrame, by: list[str], low: str, high: str, site: str, out: str = "verified", width: float | None = None) -> DataFrame:
    """Whether any site of the claim's key lies in ``[low, high)``: the first site at or after ``low`` is compared with ``high``."""
    left = claims.withColumn("__at", F.col(low))
    right = sites.select(*by, F.col(site).alias("__at"), F.col(site).alias("__site"))
    got = next_join(left, right, by, "__at", ["__site"], width)
    return got.withColumn(out, F.coalesce(F.col("__site") < F.col(high), F.lit(False))).select(*claims.columns, out)


# ---- verifiers: each returns the ``claim`` keys whose evidence the image bears out
#
# Claims have ``claim, sha256, va, low, high`` (the function's extent) and what
# their evidence names; a claim that names nothing is not borne out.


def _inside(sites: DataFrame) -> DataFrame:
    return sites.where((F.col("site") >= F.col("low")) & (F.col("site") < F.col("high"))).select("claim").distinct()


def verify_string_xref(claims: DataFrame, places: DataFrame, refs: DataFrame) -> DataFrame:
    """A reference in the extent to a place of the claim's ``string``; ``places``: ``sha256, string, va``, ``refs``: ``sha256, site, target`` (all of them, not a capped list)."""
    found = claims.where(F.length("string") > 0).join(places.select("sha256", "string", F.col("va").alias("target")), ["sha256", "string"])
    return _inside(found.join(refs.select("sha256", "site", "target"), ["sha256", "target"]))


def verify_import_xref(claims: DataFrame, import_sites: DataFrame, slots: DataFrame, refs: DataFrame) -> DataFrame:
    """A call in the extent of an import whose qualified name has the claim's ``import`` in it (ignoring case), or a reference to its slot.

    ``import_sites``: ``sha256, site, qualified``; ``slots``: ``sha256, slot, qualified``.
    """
    wanted = claims.where(F.length("import") > 0)
    names = import_sites.select("sha256", "qualified").unionByName(slots.select("sha256", "qualified")).distinct()
    named = wanted.join(names, "sha256").where(F.contains(F.lower("qualified"), F.lower("import")))
    called = named.join(import_sites.select("sha256", "qualified", "site"), ["sha256", "qualified"])
    kept = named.join(slots.select("sha256", "qualified", F.col("slot").alias("target")), ["sha256", "qualified"]).join(refs.select("sha256", "site", "target"), ["sha256", "target"])
    return _inside(called.select("claim", "low", "high", "site").unionByName(kept.select("claim", "low", "high", "site")))


def verify_constant_xref(claims: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The claim's ``constant`` is among the constants of the function that starts at its address."""
    wanted = claims.where(F.col("constant").isNotNull())
    return wanted.join(fingerprints.select("sha256", "va", "constants"), ["sha256", "va"]).where(F.array_contains("constants", F.col("constant").cast("long"))).select("claim").distinct()


def verify_callgraph_position(claims: DataFrame, calls: DataFrame) -> DataFrame:
    """The function calls the claim's ``calls``, or is called by its ``called_by``; ``calls``: ``sha256, src, dst``."""
    edges = calls.select("sha256", "src", "dst").distinct()
    down = claims.where(F.col("calls").isNotNull()).join(edges, (claims["sha256"] == edges["sha256"]) & (F.col("va") == F.col("src")) & (F.col("calls") == F.col("dst"))).select("claim")
    up = claims.where(F.col("called_by").isNotNull()).join(edges, (claims["sha256"] == edges["sha256"]) & (F.col("va") == F.col("dst")) & (F.col("called_by") == F.col("src"))).select("claim")
    return down.union(up).distinct()


def verify_named(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """A symbol (or export) at the claim's address."""
    return claims.join(symbols.select("sha256", "va").distinct(), ["sha256", "va"], "left_semi").select("claim").distinct()


#: What a match must reach to be evidence.
MATCH_SCORE, MATCH_AGREEING = 0.55, 2


def verify_cross_build_match(claims: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """The claim's ``score`` and ``agreeing`` reach what a match needs, and, where ``matches`` (``va, matched_build, score``) are stored, one of them says so."""
    good = claims.where((F.col("score") >= MATCH_SCORE) & (F.col("agreeing") >= MATCH_AGREEING) & (F.length("matched_build") > 0))
    if matches is not None:
        good = good.join(matches.where(F.col("score") >= MATCH_SCORE).select("va", "matched_build").distinct(), ["va", "matched_build"], "left_semi")
    return good.select("claim").distinct()


def verified_classes(claims: DataFrame, found: dict[str, DataFrame], out: str = "verified") -> DataFrame:
    """``claims`` with the sorted classes whose verifiers returned them (empty: none)."""
    rows = None
    for name, keys in found.items():
        one = keys.select("claim", F.lit(name).alias("__class"))
        rows = one if rows is None else rows.unionByName(one)
    listed = rows.groupBy("claim").agg(F.array_sort(F.collect_set("__class")).alias(out))
    return claims.join(listed, "claim", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def register_builds(known: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``known`` with the new ``build_id, sha256`` rows that do not contradict it, and the rejected ones."""
    joined = new.join(known.select("build_id", F.col("sha256").alias("__known")), "build_id", "left")
    clash = F.col("__known").isNotNull() & (F.col("__known") != F.col("sha256"))
    fresh = joined.where(F.col("__known").isNull()).drop("__known").dropDuplicates(["build_id"])
    return known.unionByName(fresh), joined.where(clash).drop("__known")


def stamped(rows: DataFrame, out: str = "updated") -> DataFrame:
    """Rows with the time of their save, in whole seconds."""
    return rows.withColumn(out, F.date_trunc("second", F.current_timestamp()))


def revisions(saves: DataFrame, key: list[str], order: list[str], confidence: str = "confidence") -> DataFrame:
    """The state after all saves in ``order``: one row per key.

    Adds ``revisions`` (earlier saves), ``previous_confidence`` and
    ``downgraded`` (the last save lowered the confidence). Aggregates with
    ``max_by`` combine before the shuffle, so a hot key stays small: the state
    keeps the last save and the one before it from the sorted two greatest.
    """
    value = F.struct(*order, confidence, *[c for c in saves.columns if c not in {*key, *order, confidence}])
    last = saves.groupBy(*key).agg(F.max(value).alias("__last"), (F.count(F.lit(1)) - 1).alias("revisions"))
    same = [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in key]
    marked = saves.join(last.select(*[F.col(c).alias(f"__{c}") for c in key], "__last"), same)
    before = marked.where(value < F.col("__last")).groupBy(*key).agg(F.max(value)[confidence].alias("previous_confidence"))
    joined = last.join(before.select(*[F.col(c).alias(f"__{c}") for c in key], "previous_confidence"), same, "left").drop(*[f"__{c}" for c in key])
    return joined.select(*key, "__last.*", "revisions", "previous_confidence").withColumn("downgraded", F.coalesce(F.col(confidence) < F.col("previous_confidence"), F.lit(False)))


def history(saves: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All earlier saves of every key as an ordered array of structs."""
    value = F.struct(*order, *[c for c in saves.columns if c not in {*key, *order}])
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])) == 1
    older = saves.withColumn("__new", newest).where(~F.col("__new")).groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("history"))
    return older


def lookup(symbols: DataFrame, query: str | None = None, build_id: str | None = None, min_confidence: float = 0.0, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Symbols by build, least confidence (null counts as 0) and part of a column, best first."""
    sure = F.coalesce("confidence", F.lit(0.0))
    got = symbols.where(sure >= min_confidence)
    if build_id is not None:
        got = got.where(F.col("build_id") == build_id)
    if query:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower()))
        got = got.where(hit)
    return got.orderBy(sure.desc(), *columns)
