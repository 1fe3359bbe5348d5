"""Streams: files of a folder into index tables, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.sources import tables

BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str | None = None, per_trigger: int = 100) -> DataFrame:
    """Files as they appear: ``path, sha256, size, content``; each is taken once."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(folder).where((F.col("length") > 0) & (F.col("length") <= tables.MOST_BYTES))
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add a stream's rows to a Parquet table, exactly once; ends when the input there is has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def index_files(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str | None = None) -> dict[str, StreamingQuery]:
    """Sections, strings and code index of new files, each as a table of its own."""
    makers = {"sections": tables.sections, "strings": tables.strings, "code": tables.code_index}
    return {name: append(make(new_files(spark, folder, pattern)), f"{out}/{name}", f"{checkpoint}/{name}") for name, make in makers.items()}


def window_counts(events: DataFrame, on: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by tumbling windows of event time; rows later than ``late`` are left out."""
    got = events.withWatermark(on, late).groupBy(F.window(on, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("start"), *by, "n")
