"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.llm import langid, licenses, lm, matroska, mixing, oracle, order_minhash, packing, quality, rans, simhash
from cairn.llm.common import held_out_expr, raw_text

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op9_simhash_near_dedup")
def op9(spark, sf_dir):
    got = simhash.near_duplicates(documents(spark, sf_dir))
    return got.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = held_out_expr("doc_id", 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.scorer(spark, quality.fit(docs, labels, ~held_out))
    got = docs.select("doc_id", held_out.alias("held_out"), score(raw_text(), F.col("n_chars").cast("double")).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_media_columns")
def op3(spark, sf_dir):
    raw = raw_text()
    got = documents(spark, sf_dir).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), matroska.digest(matroska.to_media(raw)).alias("d")
    )
    return got.select("doc_id", "n_bytes", "d.*")


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = held_out_expr("doc_id", 3, 1)
    predict = langid.predictor(spark, langid.fit(docs, ~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op10_token_files")
def op10(spark, sf_dir):
    got = rans.round_trip(documents(spark, sf_dir))
    return got.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


@query("op4_packing")
def op4(spark, sf_dir):
    got = packing.pack(documents(spark, sf_dir), whole=False)
    return got.withColumnsRenamed({"id": "doc_id", "sequence": "sequence_id"})


@query("op7_order_minhash")
def op7(spark, sf_dir):
    return order_minhash.neighbours(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op6_pfair_mixing", oracle.mixing_sql())
def op6(spark, sf_dir):
    return mixing.places(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op5_license_scan", oracle.license_sql())
def op5(spark, sf_dir):
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    got = lm.score(documents(spark, sf_dir), ~held_out_expr("doc_id", 7, 2))
    return got.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
