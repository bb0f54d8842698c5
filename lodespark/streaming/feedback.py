"""Feedback as a stream: counts, windows, sessions and idempotent ingestion.

Each function takes any streaming (or batch) DataFrame of events (event_id, ts, user_id, event_type, value); state is
bounded by the watermark, and late events beyond it are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Every event id once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def usefulness_counts(events: DataFrame) -> DataFrame:
    """Running counts by event type (update mode)."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and totals of closed windows (append mode)."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Closed sessions of each user (append mode)."""
    g = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def with_judgements(events: DataFrame, judgements: DataFrame) -> DataFrame:
    """Stream-static join: events with the grade of their item, null where there is none."""
    return events.join(judgements, F.get_json_object("props", "$.k").cast("bigint") == judgements["item"], "left")


def ingest(events: DataFrame, path: str, checkpoint: str, existing: Callable[[SparkSession], DataFrame]) -> object:
    """Appends to a Parquet folder what is not there yet; replaying a batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        known = existing(batch.sparkSession).select("event_id")
        batch.dropDuplicates(["event_id"]).join(known, "event_id", "left_anti").write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
