"""Streams over event tables: windowed counts with late data, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, key, n, total by event-time window; rows later than the watermark are dropped by the stream, not by a batch."""
    own = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_ts", late) if events.isStreaming else own
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return own.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """session_start, session_end, key, n."""
    own = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_ts", late) if events.isStreaming else own
    return own.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there into a table in memory (tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
