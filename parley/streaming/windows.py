"""Event-time windows and interval joins over streams; the same transformations run on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows later than this are not counted; side_of_late tells them apart.
LATENESS = "10 seconds"


def event_time(df: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Casts ts to a timestamp with zone, which watermarks need, and sets the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling(df: DataFrame, length: str, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    out = df.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, gap: str, keys: list[str], ts: str = "ts") -> DataFrame:
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def echo_pairs(worker: DataFrame, customer: DataFrame, seconds: float = 2.5, lateness: str = LATENESS) -> DataFrame:
    """Worker texts with the customer texts of the same call at most so many seconds before; both sides need call_id, ts and text. State is bounded by watermark and interval."""
    w = event_time(worker.select(F.col("call_id"), F.col("ts").alias("w_ts"), F.col("text").alias("worker_text")), "w_ts", lateness)
    c = event_time(customer.select(F.col("call_id").alias("c_call"), F.col("ts").alias("c_ts"), F.col("text").alias("customer_text")), "c_ts", lateness)
    near = F.expr(f"call_id = c_call AND c_ts <= w_ts AND c_ts >= w_ts - INTERVAL {seconds} SECONDS")
    return w.join(c, near).drop("c_call")


def dedupe(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Each key once within the lateness of its first row."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
