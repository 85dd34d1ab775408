"""Counts of events by entity and window as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, entity: str, ts: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(entity, window_start, n_events): a streaming or batch frame's events per window; events later than `late` behind the newest are left out of a stream."""
    d = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        d = d.withWatermark("_ts", late)
    return d.groupBy(F.col(entity).alias("entity"), F.window("_ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select("entity", F.col("w.start").alias("window_start"), "n_events")


def run_once(spark: SparkSession, source: DataFrame, path: str, checkpoint: str) -> None:
    """Writes a streaming frame's rows that are complete now to parquet, and ends."""
    source.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
