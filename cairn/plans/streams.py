"""Streaming queries: a stream is run to the end of its input and its table returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.storage import shared_path
from cairn.streaming import ingest


@query(
    "stream_window_counts",
    "SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_window_counts(spark, sf_dir):
    """Events by day and type, as a stream with a watermark; a window's last update counts."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path.rsplit("/", 1)[0] + "/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = ingest.window_counts(rows, "ts", ["event_type"], "1 day", "1 hour")
    out, saved = shared_path(spark, "stream"), shared_path(spark, "stream-state")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is tried again replaces itself

    stream = counted.writeStream.outputMode("update").option("checkpointLocation", saved).foreachBatch(keep).trigger(availableNow=True).start()
    stream.awaitTermination()
    got = spark.read.parquet(out)
    return got.groupBy(F.col("start").cast("long").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))
