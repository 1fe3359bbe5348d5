"""Linkage: are the classes and members that code requires provided, and are types sound.

Tables: ``classes(name, parent, source, access, seq)``, ``interfaces(name, parent)``,
``members(owner, kind, name, descriptor, is_abstract, is_static, has_code)``,
``requirements(kind, owner, name, descriptor, from_class, seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import reach
from cairn.operators.grouping import first_definition

#: Prefixes of platform classes, which are not checked.
PLATFORM = ("java.", "javax.", "jdk.", "sun.", "com.sun.", "org.w3c.", "org.xml.", "org.ietf.")
ROOT = "java.lang.Object"
#: Members of the root class, which every class has.
ROOT_MEMBERS = ["<init>", "clone", "equals", "finalize", "getClass", "hashCode", "notify", "notifyAll", "toString", "wait"]


def is_platform(name: Column) -> Column:
    found = F.lit(False)
    for p in PLATFORM:
        found = found | F.startswith(name, F.lit(p))
    return found


def arity(descriptor: Column) -> Column:
    """Number of parameters of a method descriptor; -1 without parentheses."""
    inside = F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1)
    return F.when(~descriptor.rlike(r"^\([^)]*\)"), -1).otherwise(F.size(F.regexp_extract_all(inside, F.lit(r"\[*(?:L[^;]+;|[BCDFIJSZ])"), F.lit(0))))


def universe(own: DataFrame, provided: DataFrame, name: str = "name", order: str = "seq") -> DataFrame:
    """One definition per name: own ones override provided ones, and earlier ones later ones; those without an order come last."""
    both = own.withColumn("__side", F.lit(0)).unionByName(provided.withColumn("__side", F.lit(1)))
    return first_definition(both, [name], ["__side", F.col(order).asc_nulls_last()]).drop("__side")


def counted_members(members: DataFrame, classes: DataFrame, by: tuple[str, ...] = ("order",)) -> DataFrame:
    """Members of the definitions that count: those of an overridden copy of a class are no longer there."""
    first = classes.select(F.col("name").alias("owner"), *by).distinct()
    return members.join(first, ["owner", *by], "left_semi")


def missing_owners(requirements: DataFrame, classes: DataFrame) -> DataFrame:
    """Required classes that nothing provides, each with its first witness: ``owner, from_class, uses``.

    Array types and platform classes are not asked for.
    """
    asked = requirements.where(~F.startswith("owner", F.lit("[")) & ~is_platform(F.col("owner")))
    lost = asked.join(classes.select(F.col("name").alias("owner")), "owner", "left_anti")
    return lost.groupBy("owner").agg(F.min_by("from_class", "seq").alias("from_class"), F.count(F.lit(1)).alias("uses"))


def resolve_members(requirements: DataFrame, classes: DataFrame, interfaces: DataFrame, members: DataFrame, strict: bool = True) -> DataFrame:
    """Distinct member requirements with ``outcome``: found, unchecked or missing.

    A member may be in the owner or any supertype. It is unchecked when a
    supertype is not provided (platform ones included); ``strict`` takes the
    root class for known, so an ordinary class can miss a member.
    """
    parents = classes.select("name", "parent").where("parent IS NOT NULL").unionByName(interfaces.select("name", "parent")).distinct()
    wanted = requirements.where("name IS NOT NULL").select("kind", "owner", "name", "descriptor").distinct()
    wanted = wanted.join(classes.select(F.col("name").alias("owner")), "owner", "left_semi")
    above = reach(parents, wanted.select(F.col("owner").alias("origin")).distinct(), None, "name", "parent").select(F.col("origin").alias("owner"), F.col("node").alias("holder"))
    held = members.select(F.col("owner").alias("holder"), "kind", "name", "descriptor").distinct().withColumn("__has", F.lit(True))
    looked = wanted.join(above, "owner").join(held, ["holder", "kind", "name", "descriptor"], "left")
    known = classes.select(F.col("name").alias("holder"), F.lit(True).alias("__known"))
    looked = looked.join(known, "holder", "left")
    root = F.col("holder") == ROOT
    open_end = F.col("__known").isNull() & ~(root & F.lit(strict))
    on_root = root & F.lit(strict) & F.col("name").isin(ROOT_MEMBERS) & (F.col("kind") == "method")
    rows = looked.groupBy("kind", "owner", "name", "descriptor").agg(
        F.bool_or(F.coalesce("__has", F.lit(False)) | on_root).alias("has"), F.bool_or(open_end).alias("open")
    )
    return rows.select("kind", "owner", "name", "descriptor", F.when(F.col("has"), "found").when(F.col("open"), "unchecked").otherwise("missing").alias("outcome"))


def scorecard(requirements: DataFrame, classes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: distinct, platform, resolved, unchecked and missing references."""
    refs = requirements.select("kind", "owner", "name", "descriptor").distinct()
    platform = is_platform(F.col("owner"))
    known = classes.select(F.col("name").alias("owner"), F.lit(True).alias("known")).distinct()
    marked = refs.join(known, "owner", "left").join(resolved, ["kind", "owner", "name", "descriptor"], "left")
    return marked.agg(
        F.count(F.lit(1)).alias("distinct_references"),
        F.count_if(platform).alias("platform_references"),
        F.count_if(~platform & (F.coalesce(F.col("outcome") == "found", F.lit(False)) | (F.col("name").isNull() & F.col("known")))).alias("resolved"),
        F.count_if(F.col("outcome") == "unchecked").alias("unchecked"),
        F.count_if(F.col("outcome") == "missing").alias("missing_members"),
        F.countDistinct(F.when(~platform & ~F.startswith("owner", F.lit("[")) & F.col("known").isNull(), F.col("owner"))).alias("missing_classes"),
    )


def entrypoints(wanted: DataFrame, classes: DataFrame, members: DataFrame, near: int = 5) -> DataFrame:
    """``entrypoint`` rows with ``problems``, up to ``near`` classes of the same simple name, and ``ok``."""
    simple = F.element_at(F.split("name", r"\."), -1)
    made = members.where("kind = 'method' AND name = '<init>'").select(F.col("owner").alias("__owner")).distinct()
    named = wanted.join(classes, wanted["entrypoint"] == classes["name"], "left").join(made, F.col("entrypoint") == F.col("__owner"), "left")
    close = wanted.withColumn("__simple", F.element_at(F.split("entrypoint", r"\."), -1)).join(classes.select(F.col("name").alias("__name"), simple.alias("__simple")), "__simple")
    close = close.groupBy("entrypoint").agg(F.slice(F.array_sort(F.collect_set("__name")), 1, near).alias("near"))
    access = F.coalesce("access", F.array().cast("array<string>"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("name").isNull(), F.lit("missing")),
            F.when(F.col("name").isNotNull() & F.array_contains(access, "abstract"), F.lit("abstract")),
            F.when(F.col("name").isNotNull() & F.array_contains(access, "interface"), F.lit("interface")),
            F.when(F.col("name").isNotNull() & F.col("__owner").isNull(), F.lit("no_constructor")),
        )
    )
    got = named.select("entrypoint", problems.alias("problems")).join(close, "entrypoint", "left")
    none = F.array().cast("array<string>")
    return got.select("entrypoint", "problems", F.when(F.array_contains("problems", "missing"), F.coalesce("near", none)).otherwise(none).alias("near"), (F.size("problems") == 0).alias("ok"))


def unimplemented(classes: DataFrame, interfaces: DataFrame, members: DataFrame) -> DataFrame:
    """Abstract methods that a concrete own class neither has nor inherits: ``owner, name, descriptor, declared_in``.

    A class with any supertype outside the tables (the root apart) is not judged.
    """
    parents = classes.select("name", "parent").where("parent IS NOT NULL").unionByName(interfaces.select("name", "parent")).distinct()
    concrete = classes.where(~F.array_contains("access", "abstract") & ~F.array_contains("access", "interface")).select(F.col("name").alias("origin"))
    above = reach(parents, concrete, None, "name", "parent")
    known = classes.select(F.col("name").alias("node"))
    unknown = above.where(F.col("node") != ROOT).join(known, "node", "left_anti").select("origin").distinct()
    judged = above.join(unknown, "origin", "left_anti")
    methods = members.where("kind = 'method' AND NOT is_static")
    held = judged.join(methods.select(F.col("owner").alias("node"), "name", "descriptor", "is_abstract", "has_code"), "node")
    bare = F.col("is_abstract") & ~F.col("has_code")
    required = held.where(bare).groupBy("origin", "name", "descriptor").agg(F.min_by("node", F.struct("level", "node")).alias("declared_in"))
    present = held.where(~bare).select("origin", "name", "descriptor").distinct()
    return required.join(present, ["origin", "name", "descriptor"], "left_anti").select(F.col("origin").alias("owner"), "name", "descriptor", "declared_in")


def broken_overrides(classes: DataFrame, interfaces: DataFrame, members: DataFrame, listed: int = 4) -> DataFrame:
    """Methods that no supertype declares though one declares the name with as many, other, parameters."""
    parents = classes.select("name", "parent").where("parent IS NOT NULL").unionByName(interfaces.select("name", "parent")).distinct()
    above = reach(parents, classes.select(F.col("name").alias("origin")), None, "name", "parent").where("level > 0")
    methods = members.where("kind = 'method' AND NOT is_static AND name NOT IN ('<init>', '<clinit>')").select("owner", "name", "descriptor", arity(F.col("descriptor")).alias("arity"))
    inherited = above.join(methods.withColumnRenamed("owner", "node"), "node").select(F.col("origin").alias("owner"), "node", "name", F.col("descriptor").alias("other"), "arity")
    alone = methods.join(inherited.select("owner", "name", F.col("other").alias("descriptor")).distinct(), ["owner", "name", "descriptor"], "left_anti")
    close = alone.join(inherited, ["owner", "name", "arity"])
    return close.groupBy("owner", "name", "descriptor").agg(F.slice(F.array_sort(F.collect_set(F.concat_ws(".", "node", F.concat("name", "other")))), 1, listed).alias("overrides"))


#: What data files are called, and folders that hold none.
DATA_SUFFIXES, NO_DATA = ("csv", "json", "faction", "ship", "variant"), ("out", "test-out", "build", "target", "lib", "jars", "src")
#: A qualified class name: lower-case packages, then a capital.
CLASS_NAME = r"\b((?:[a-z][A-Za-z0-9_]*\.)+[A-Z][A-Za-z0-9_$]*)\b"


def is_data_path(path: Column) -> Column:
    """Whether a path (relative to the folder asked about) is a data file's: under ``data`` or at the top, no hidden part."""
    parts = F.split(path, "/")
    suffix = F.element_at(F.split(path, r"\."), -1).isin(*DATA_SUFFIXES)
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    first = F.element_at(parts, 1)
    return suffix & ~hidden & ~first.isin(*NO_DATA) & ((first == "data") | (F.size(parts) == 1))


def class_names(texts: DataFrame, file: str, value: str) -> DataFrame:
    """``file, class``: the qualified class names in data files, each once a file."""
    names = F.array_distinct(F.regexp_extract_all(value, F.lit(CLASS_NAME), F.lit(1)))
    return texts.select(F.col(file).alias("file"), F.explode(names).alias("class")).distinct()


def data_references(refs: DataFrame, classes: DataFrame, listed: int = 4) -> DataFrame:
    """Classes that data files name (``class, file``) and nothing defines: ``missing`` if the package is ours, else ``unresolved_external``."""
    package = F.regexp_extract("class", r"^(.*)\.[^.]*$", 1)
    own = classes.select(F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("package"), F.lit(True).alias("own")).distinct()
    lost = refs.where(~is_platform(F.col("class"))).join(classes.select(F.col("name").alias("class")), "class", "left_anti").withColumn("package", package)
    rolled = lost.groupBy("class", "package").agg(F.countDistinct("file").alias("files"), F.slice(F.array_sort(F.collect_set("file")), 1, listed).alias("listed"))
    return rolled.join(own, "package", "left").select("class", "files", "listed", F.when(F.col("own"), "missing").otherwise("unresolved_external").alias("kind"))
