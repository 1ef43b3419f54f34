"""Keyed changes to a table, as plans over its old rows and the incoming ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evidara.operators.dedup import first_wins
from evidara.sources.files import written


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old and the first new row of each key that old hasn't."""
    return old.unionByName(first_wins(new, keys, order).join(old.select(keys).distinct(), keys, "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], keep: list[str] = ()) -> DataFrame:
    """old with the rows of new in place of those of their keys; the first in the order wins; columns in keep stay as they were."""
    won = first_wins(new, keys, order).select(old.columns)
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        won = won.join(before, keys, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).select(old.columns)
    return old.join(won.select(keys), keys, "left_anti").unionByName(won)


def replace_collection(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in new are replaced by new's."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def soft_delete(df: DataFrame, gone: Column, at: Column, deleted: str = "deleted_at", version: str = "version") -> DataFrame:
    """Rows that are gone get a time of deletion and the next version; deleted ones stay as they are."""
    now = gone & F.col(deleted).isNull()
    return df.withColumns({deleted: F.when(now, at).otherwise(F.col(deleted)), version: F.col(version) + now.cast("int")})


def without(df: DataFrame, gone: Column) -> DataFrame:
    """df without the rows that are gone; a condition that is null keeps its row."""
    return df.where(~F.coalesce(gone, F.lit(False)))


def observed(seen: Observation) -> int:
    """The one number of an observation; 0 where the plan has left its rows out, as it could tell that there are none."""
    row = seen._jo.getRow()
    return row.getLong(0) if row.length() else 0


def loaded(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], name: str, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the relation after a load, written to the shared folder; its counts): rows of keys that old has are ignored, or replaced.

    Counts are a row (relation, processed, inserted) that the writing job observes, without another look at old or new:
    processed are the rows that came; inserted those of them that were put in, which an upsert does with every row.
    """
    spark = new.sparkSession
    came, put = Observation(), Observation()
    new = new.observe(came, F.count(F.lit(1)).alias("n"))
    if replace:
        after = upsert(old, new, keys, order)
    else:
        fresh = first_wins(new, keys, order).join(old.select(keys).distinct(), keys, "left_anti").select(old.columns)
        after = old.unionByName(fresh.observe(put, F.count(F.lit(1)).alias("n")))
    after, _ = written(after, name)
    processed = observed(came)
    counts = spark.createDataFrame([(name, processed, processed if replace else observed(put))], "relation string, processed long, inserted long")
    return after, counts


def edited(items: Column, remove: Column, add: Column) -> Column:
    """An array without the items to remove, and with those to add that it hasn't."""
    return F.array_union(F.array_except(items, remove), add)
