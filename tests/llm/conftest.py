import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # clashing names: operators use some of these for their own columns
        T.StructField("id", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

EN = "the quick brown fox jumps over the lazy dog and then it runs home. "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft nach hause. "
FR = "le renard brun rapide saute par dessus le chien paresseux et rentre chez lui. "


def _rows():
    texts = [
        (0, EN * 3, "en", "a"),
        (1, EN * 3, "en", "b"),
        (2, EN * 3 + "extra", "en", "a"),
        (3, DE * 4, "de", "a"),
        (4, FR * 4, "fr", "c"),
        (5, None, "en", "a"),
        (6, "", None, None),
        (7, "12 34 !!!", "de", "b"),
        (8, "Hello", "en", None),
        (8, "Hello", "en", None),  # a repeated row
        (9, "word " * 30_000, "en", "a"),  # very long
        (10, "Released under the MIT License. Apache License, Version 2.0! CC BY-NC 4.0", "en", "a"),
        (None, "a row without an id. " * 5, "en", "a"),
        (11, DE, None, "b"),
        (12, "naïve × 漢字 <|endoftext|> don't\x01 ,'s", "fr", "c"),
        (13, "two words", "en", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w", "v") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 1), (3, 1), (7, 0), (9, 0), (10, None), (None, 1), (4, 1)], "doc_id long, quality int")
