"""Fixed-window rates of events, in batch and as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, user: str, at: str, width: str, most: int, late: str | None = None) -> DataFrame:
    """Windows in which a user has more than `most` events. late: how long a stream waits for late events."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if late else timed
    counted = timed.groupBy(F.window(at, width).alias("w"), user).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(F.col("w.start").alias("window_start"), user, "n")


def append_log(events: DataFrame, path: str, checkpoint: str):
    """An append-only log of a stream: what has come so far is written, exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def alive(issued: str, now, minutes: int = 15):
    """Whether something issued before now is still valid."""
    return (F.col(issued) < now) & (F.col(issued) + F.expr(f"INTERVAL {minutes} MINUTES") > now)
