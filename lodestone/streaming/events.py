"""Event-time forms over a stream or a table of events (ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    rows = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.select("user_id", F.col("w.start").alias("start"), "last", "n")


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, on_change) -> None:
    """Hands every batch of new files to on_change(df, batch id) until none is left; a restart goes on where it stopped."""
    spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
