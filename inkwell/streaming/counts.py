"""Streaming counts over events: days, running tickets, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream with event time `at`; times without a zone are UTC."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Tumbling UTC days; a day is closed and its state dropped once the watermark has passed it."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day"), by).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n")


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """A finite stream run to its end into a table in memory: for tests and small inputs. Exactly-once file sinks use `to_files`."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
