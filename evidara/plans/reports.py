"""Owner-scoped lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.dedup import latest


def owned(df: DataFrame, owner: str, who: object, deleted: Column) -> DataFrame:
    """Rows of one owner that aren't deleted."""
    return df.where((F.col(owner) == who) & ~deleted)


def parent_list(parents: DataFrame, children: DataFrame, key: str, order: list[Column], take: int, at: str, tie: str, status: str | None = None) -> DataFrame:
    """The first `take` parents with the number of their children and the newest child's time and status.

    A wanted status is compared after the cut, so fewer than `take` may be left.
    """
    page = parents.orderBy(*order).limit(take)
    own = children.join(page.select(key), key, "left_semi")
    counts = own.groupBy(key).agg(F.count("*").alias("n_children"))
    newest = latest(own, [key], at, tie).select(key, F.col(at).alias("latest_at"), F.col("status").alias("latest_status"))
    out = page.join(counts, key, "left").join(newest, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return out.where(F.col("latest_status") == status) if status else out


def dashboard(visits: DataFrame, key: str, status: str, at: str, as_of: str) -> DataFrame:
    """Active parents, pending visits and the day's visits."""
    day = F.to_date(F.lit(as_of))
    pending = F.col(status) == "IN_PROGRESS"
    return visits.agg(F.count_distinct(F.when(pending, F.col(key))).alias("active"), F.count_if(pending).alias("pending"), F.count_if(F.to_date(at) == day).alias("today"))


def complete(*filled: Column) -> Column:
    """The share of filled categories in whole per cent."""
    return F.floor(sum((f.cast("int") for f in filled[1:]), filled[0].cast("int")) * 100 / len(filled) + 0.5)
