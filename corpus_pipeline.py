"""Corpus pipeline: language, quality, near-duplicates, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.

The mixing stage keeps every row; its decision is their order, which it writes
(globally sorted) and which the packing stage follows, by file and row, when it
cuts the sequences.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cairn.llm import langid, mixing, near_texts, packing, quality
from cairn.llm.common import held_out_expr, raw_text, shared_path

#: A language must be told with at least this score (a text of random letters stays below it in nine cases of ten, a text of one
#: language in two of a thousand; see the README), and a text be of quality with at least that.
LANGUAGE_SCORE, QUALITY_SCORE = 0.7, 0.3


def language(spark, docs, sf_dir):
    """Keep the documents whose language is told; ``und`` and doubtful ones go."""
    predict = langid.predictor(spark, langid.fit(docs, ~held_out_expr("doc_id", 3, 1)))
    told = docs.withColumn("__language", predict("text")).where((F.col("__language.lang_pred") != langid.UNDETERMINED) & (F.col("__language.score") >= LANGUAGE_SCORE))
    return told.select(*docs.columns)


def good(spark, docs, sf_dir):
    """Keep the documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.scorer(spark, quality.fit(docs, labels, ~held_out_expr("doc_id", 5, 0)))
    kept = docs.withColumn("__quality", score(raw_text(), F.col("n_chars").cast("double"))).where(F.col("__quality") >= QUALITY_SCORE)
    return kept.select(*docs.columns)


def distinct(spark, docs, sf_dir):
    """Keep one document of each group of texts whose five-word shingles agree to 0.8 or more, the one with the smallest id."""
    return near_texts.representatives(docs)


def mixed(spark, docs, sf_dir):
    """All documents in the order that gives every source its target weight."""
    return mixing.mix(docs)


def packed(spark, docs, sf_dir):
    """Sequences of token ids in the order of the files and rows of ``docs``."""
    try:
        where = docs.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
        where = where.withColumn("__part", F.regexp_extract("__file", r"part-(\d+)", 1).cast("long"))
        order = ["__part", "__file", "__row"]
    except AnalysisException:  # not read from files: the order is worked out anew
        at = mixing.places(docs).select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("slot").alias("__slot"), F.col("place").alias("__place"))
        where = docs.join(at, docs["doc_id"].eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source")))
        order = ["__slot", "__place"]
    return packing.pack(where, order).withColumnsRenamed({"id": "doc_id", "sequence": "sequence_id"})


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]
#: Learned models and tokenizers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
