"""Streaming: entries from a landing folder, and usage counts by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import ENTRY


def entries(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Uses of a key by tumbling windows of event time; events later than the watermark are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "key").agg(F.count("*").alias("n")).select("window.start", "key", "n")


def append_log(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch once to a Parquet log (batch_id tells a replay)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
