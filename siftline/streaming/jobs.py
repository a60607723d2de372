"""The stateful behaviour as Structured Streaming: event-time windows, idempotent appends, resumable work.

Event time, watermarks and late rows are this library's additions; a stream read to its end gives
what the batch operators give (tests/test_sources.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of events as they come, with event time `at`."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, n by tumbling days (WIN-16)."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "event_type", "n")


def busy_minutes(events: DataFrame, most: int, late: str = "10 minutes") -> DataFrame:
    """Sliding minutes in which an event type came more than `most` times (WIN-15, ST-06)."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", "60 seconds", "10 seconds").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(F.col("w.start").alias("from"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, started, ended, n of runs of events without a longer gap."""
    counted = events.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def once(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Each key's first row; repeats that come within `late` are dropped, and the state behind them too (ST-07)."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def work(stream: DataFrame, done: str, key: str, step: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Runs step on rows that aren't done and appends its rows to `done`; a restarted query repeats nothing (ST-01).

    Every batch writes a folder of its own, over what a broken attempt at the same batch left."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(done)
        fresh = rows.dropDuplicates([key])
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            before = spark.read.parquet(done).where(F.col("batch") != number).select(key)
            fresh = fresh.join(before, key, "left_anti")
        step(fresh).write.mode("overwrite").parquet(f"{done}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
