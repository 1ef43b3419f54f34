"""Streams into keyed tables: merges that may be replayed, and duplicates left out within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators.dedup import first_wins


def upsert_stream(changes: DataFrame, table: str, checkpoint: str, keys: list[str], at: str, tie: str, late: str):
    """Start a query that merges a stream of changes into a table of the last row a key, what has come so far.

    Changes with the same keys, `at` and tie are one change that was sent again: while the watermark lets it come, it is left out. Every batch is a
    folder of its own under table, named by its number and overwritten if the batch runs again, so that a replay changes nothing.
    A batch keeps the last change of each key; latest() takes the last over batches.
    """

    def merge(batch: DataFrame, number: int) -> None:
        last = first_wins(batch, keys, [F.col(at).desc(), F.col(tie).desc()])
        last.write.mode("overwrite").option("compression", "zstd").parquet(f"{table}/batch={number:012d}")

    once = changes.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, at, tie])
    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, schema, keys: list[str], at: str, tie: str) -> DataFrame:
    """The table that upsert_stream has made: the last row of each key over all batches."""
    rows = spark.read.schema(schema).parquet(table)
    return first_wins(rows.select(*[f.name for f in rows.schema if f.name != "batch"]), keys, [F.col(at).desc(), F.col(tie).desc()])


def compacted(spark: SparkSession, table: str, schema, keys: list[str], at: str, tie: str, to: str) -> None:
    """latest() written as the first batch of another table, so that batches don't pile up."""
    latest(spark, table, schema, keys, at, tie).write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/batch={0:012d}")
