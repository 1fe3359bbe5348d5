"""Text and byte queries (survey ids STR, AGG-01, AGG-08, FLT, WIN-04, SRC-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import grouping, text
from cairn.plans.registry import query
from cairn.session import table

ENTROPY = """
    c AS (SELECT doc_id, lang, ch, count(*) AS n FROM (SELECT doc_id, lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, lang, ch),
    t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
    h AS (SELECT c.doc_id, c.lang, round(-sum(n / total * log2(n / total)), 4) AS entropy FROM c JOIN t USING (doc_id) GROUP BY c.doc_id, c.lang)
"""
THRESHOLD = 4.3


@query("byte_entropy", f"WITH {ENTROPY} SELECT doc_id, entropy FROM h")
def byte_entropy(spark, sf_dir):
    """AGG-01: bits per character of every document."""
    return text.character_entropy(table(spark, sf_dir, "documents"), "doc_id", "text", digits=4)


@query("packed_filter", f"WITH {ENTROPY} SELECT lang, count(*) AS documents, count(*) FILTER (WHERE entropy >= {THRESHOLD}) AS packed FROM h GROUP BY lang")
def packed_filter(spark, sf_dir):
    """FLT-01, FLT-02, EVD-02: rows above an entropy threshold, counted by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("k", F.struct("doc_id", "lang"))
    found = text.character_entropy(docs, "k", "text", digits=4).select("k.lang", "entropy")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("entropy") >= THRESHOLD).alias("packed"))


@query(
    "printable_runs",
    """
    WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '[a-z]{5,}')) AS run FROM pages)
    SELECT page_id, run, count(*) AS n, length(run) AS chars FROM r GROUP BY page_id, run
    """,
)
def printable_runs(spark, sf_dir):
    """STR-01: maximal runs of at least five members of a character class."""
    runs = table(spark, sf_dir, "pages").select("page_id", F.explode(text.printable_runs(F.col("html"), 5, "a-z")).alias("run"))
    return runs.groupBy("page_id", "run").agg(F.count(F.lit(1)).alias("n")).withColumn("chars", F.length("run").cast("long"))


@query("regex_filter_ci", "SELECT doc_id, source FROM documents WHERE regexp_matches(text, 'licen[sc]e', 'i')")
def regex_filter_ci(spark, sf_dir):
    """FLT-03, FLT-04, FLT-05: rows that match, ignoring case."""
    return text.matching(table(spark, sf_dir, "documents"), "text", "licen[sc]e")[0].select("doc_id", "source")


@query("substring_filter_ci", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'a1') OR contains(lower(html), 'worthless')")
def substring_filter_ci(spark, sf_dir):
    """FLT-06: rows where one of the columns contains a part, ignoring case."""
    return text.containing(table(spark, sf_dir, "pages"), ["html"], "WORTHLESS").unionAll(text.containing(table(spark, sf_dir, "pages"), ["url"], "A1")).select("page_id", "url").distinct()


@query(
    "string_frequency_top100",
    r"""
    WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents)
    SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100
    """,
)
def string_frequency_top100(spark, sf_dir):
    """AGG-08: the hundred most frequent words, ties by word."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("word"))
    return grouping.frequency_top(words, "word", 100)


@query("package_histogram", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def package_histogram(spark, sf_dir):
    """AGG-07: rows by package."""
    return grouping.histogram(table(spark, sf_dir, "documents"), ["lang", "source"])


SNIFFED = {"pe": "4D5A" + "00" * 58 + "40000000" + "50450000", "dos_mz": "4D5A" + "00" * 62, "elf": "7F454C4602", "macho": "CFFAEDFE07", "macho_fat": "CAFEBABE00000002", "java_class": "CAFEBABE00000034", "zip": "504B030414", "gzip": "1F8B08", "ar": "213C617263683E0A"}


KINDS = "', '".join([*SNIFFED, "unknown"])


@query("sniff_magic", f"SELECT o_orderkey AS id, list_element(['{KINDS}'], CAST(o_orderkey % {len(SNIFFED) + 1} AS INTEGER) + 1) AS kind FROM orders")
def sniff_magic(spark, sf_dir):
    """SRC-02: formats told by their first bytes; each order carries one of the magics before its own bytes."""
    heads = F.array(*[F.unhex(F.lit(h)) for h in [*SNIFFED.values(), "00"]])
    key = F.col("o_orderkey")
    content = F.concat(F.element_at(heads, (key % (len(SNIFFED) + 1) + 1).cast("int")), F.encode("o_orderpriority", "UTF-8"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), content.alias("content")).select("id", text.sniff(F.col("content")).alias("kind"))


GRAMS = r"""
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS words FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) ELSE [] END AS grams FROM w),
    x AS (SELECT doc_id, unnest(grams) AS gram FROM g)
"""


@query(
    "ngram5_features",
    f"WITH {GRAMS} SELECT g.doc_id AS doc_id, count(DISTINCT x.gram) AS grams, min(substr(sha256(x.gram), 1, 8)) AS first_hash FROM g LEFT JOIN x ON g.doc_id = x.doc_id GROUP BY g.doc_id",
)
def ngram5_features(spark, sf_dir):
    """WIN-04, STR-07, AGG-09: distinct 5-grams of every document and their least short hash."""
    grams = table(spark, sf_dir, "documents").select("doc_id", text.ngrams(text.words(F.col("text")), 5).alias("grams"))
    # numbers are told apart much faster than long strings
    distinct = F.size(F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))))
    return grams.select("doc_id", distinct.cast("long").alias("grams"), F.array_min(F.transform("grams", lambda g: text.short_hash(g, 8))).alias("first_hash"))


@query(
    "descriptor_arity",
    """
    SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_linenumber AS BIGINT) AS arity FROM lineitem
    """,
)
def descriptor_arity(spark, sf_dir):
    """STR-10, STR-11: parameters of a method descriptor; each line makes one with as many as its number."""
    from cairn.operators.linkage import arity

    kinds = F.array(*[F.lit(x) for x in ("I", "[J", "Ljava/lang/String;", "[[Lp/Q;", "D")])
    one = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.element_at(kinds, (i % 5 + 1).cast("int")))
    made = F.concat(F.lit("("), F.array_join(one, ""), F.lit(")V"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", arity(made).cast("long").alias("arity"))
