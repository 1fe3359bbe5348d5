import pytest

import corpus_pipeline as p
from cairn.llm import mixing, near_texts


@pytest.fixture(scope="module")
def sf(spark, docs, labels, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    plain.limit(0).write.parquet(f"{base}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{base}/none/labels.parquet")
    return base


def test_stages_keep_columns_and_their_decisions_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]
    told = p.language(spark, docs, sf)
    assert told.columns == docs.columns
    assert not {r.doc_id for r in told.collect()} & {5, 6, 7}  # null, empty, without letters
    kept = p.good(spark, told, sf)
    assert kept.columns == docs.columns and {0, 1, 3} <= {r.doc_id for r in kept.collect()}
    once = p.distinct(spark, docs, sf)
    assert once.count() == near_texts.groups(docs)[1].select("label").distinct().count()
    assert {0} == {r.doc_id for r in once.collect()} & {0, 1}
    in_order = p.mixed(spark, docs, sf)
    assert in_order.columns == docs.columns and in_order.count() == docs.count()


def test_packing_follows_the_mixed_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = f"{sf}/mixed"
    p.mixed(spark, docs, sf).write.parquet(path)
    pieces = p.packed(spark, spark.read.parquet(path), sf).orderBy("sequence_id", "offset").collect()
    seen = list(dict.fromkeys(r.doc_id for r in pieces))
    want = [r.id for r in mixing.places(docs).orderBy("slot", "place").collect()]
    assert seen == want
    memory = p.packed(spark, spark.createDataFrame(docs.collect(), docs.schema), sf).orderBy("sequence_id", "offset").collect()
    assert list(dict.fromkeys(r.doc_id for r in memory)) == want


def test_run_and_empty_tables(spark, sf):
    assert p.run(spark, sf).count() > 0
    assert p.run(spark, f"{sf}/none").count() == 0
