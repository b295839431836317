"""Event windows, on streams and on tables alike (an extension). Event times without zone are read as UTC first, as watermarks need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of events per window."""
    grouped = timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, n: runs of a user's events less than ``gap`` apart."""
    grouped = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def indexed(chunks: DataFrame, checkpoint: str, take) -> StreamingQuery:
    """Runs ``take(batch, number)`` on every micro-batch of a stream of chunks, each chunk hash once a batch: incremental indexing of a stream."""
    once = lambda batch, number: take(batch.dropDuplicates(["doc_id", "chunk_hash"]), number)
    return chunks.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
