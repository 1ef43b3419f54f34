"""Ordered deduplication and picks per group. Orders are always total, so that results don't vary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.sources.files import written


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group in the order, numbered from 1 in rank if that is named.

    Spark keeps k rows per group and task before it shuffles (WindowGroupLimit).
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of the latest `at` per key; of ties the largest tie."""
    return top_k(df, keys, [F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()], 1)


def sequence(df: DataFrame, keys: list[str], order: list[Column], name: str = "number", given: DataFrame | None = None) -> DataFrame:
    """df with a number for each row of a key, from 1, or from after the last of given (keys, last).

    Rows are dealt by ranges of key and order, so that a key of any size is in several tasks; a key's rows in the ranges before
    its own are counted, a number for each key and range, and added to the place in the range. The order is total.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, before = "_part", "_before"
    # Written, as ranges are drawn from a sample: numbers and counts have to be of the same ranges.
    dealt, _ = written(df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if given is not None:
        offsets = offsets.join(given.select(*keys, "last"), keys, "left").withColumn(before, F.col(before) + F.coalesce("last", F.lit(0))).drop("last")
    placed = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)))
    # Keys may be null: they meet as equals.
    side = offsets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(part).alias("_range"), before)
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col(part) == F.col("_range"))
    return placed.join(side, met).select(*df.columns, (F.col(name) + F.col(before)).alias(name))


def reconciled(first: DataFrame, second: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The union of both with one row a key; rows of the first come before those of the second."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1))).withColumn("_key", key)
    return first_wins(both, ["_key"], [F.col("_source").asc(), *order]).drop("_source", "_key")
