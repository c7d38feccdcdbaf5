"""Signal views of plain tables: lines from events, traces from arrays, bytes from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.operators.edges import toggles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def event_edges(spark: SparkSession, sf_dir: str, channel: str = "user_id") -> DataFrame:
    """Each event toggles its line; the tick is the event's microsecond."""
    events = table(spark, sf_dir, "events").select(F.col(channel).cast("string").alias("channel"), micros("ts").alias("tick"))
    return toggles(events)


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each event type as an analog trace; k counts in order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("k"), F.col("value")
    )
    return rows


def embedding_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a trace of its numbers."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("channel"), F.posexplode("embedding").alias("k", "value"))
    return rows.select("channel", F.col("k").cast("long").alias("k"), F.col("value").cast("double").alias("value"))
