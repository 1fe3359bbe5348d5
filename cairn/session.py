"""Session defaults and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables the driver writes under every ``sf_dir``.
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(app: str = "cairn", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # workers inherit it; the cores are Spark's
        os.environ.setdefault(name, "1")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read lazily so that pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
