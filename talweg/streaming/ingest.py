"""Structured Streaming: patches as they arrive to summaries, and event counts in windows.

A patch is complete in itself, so its summary is a stateless map and needs no watermark. A batch writes its own folder,
overwriting what an earlier try at the same batch left, so a batch that runs twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talweg.operators import kernels, topology

PATCH = "patch_id long, label int, h int, w int, z array<double>"


def summaries(patch_rows: DataFrame, tau: int = 2) -> DataFrame:
    """patch_id, label, leaves, junctions, roots."""
    return topology.junctions(kernels.merge_tree(patch_rows, tau), "patch_id", "label")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, tau: int = 2, files_per_batch: int = 64) -> StreamingQuery:
    """Summarises Parquet patch rows that come into `source`, until all that is there is done; each batch under target/batch=N."""
    rows = spark.readStream.schema(PATCH).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(part: DataFrame, batch: int) -> None:
        summaries(part, tau).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolled_up(spark: SparkSession, target: str) -> DataFrame:
    """Totals by label over all batches so far."""
    return spark.read.parquet(target).groupBy("label").agg(F.count("*").alias("patches"), F.sum("leaves").alias("leaves"), F.sum("junctions").alias("junctions"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums of values by type in tumbling windows of ts; rows later than `late` are dropped once a window is closed."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
