"""Deletes across relations that refer to one another: what a delete removes, sets to null, or is refused for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.sources.files import written

RESTRICT, CASCADE, SET_NULL = "RESTRICT", "CASCADE", "SET NULL"


@dataclass(frozen=True)
class Reference:
    """child.column refers to the key of parent; on_delete says what becomes of the child's row."""

    child: str
    column: str
    parent: str
    on_delete: str = RESTRICT


def parents_first(names: list[str], references: list[Reference]) -> list[str]:
    """The relations in an order in which each comes after all that its rows cascade from; a cycle is an error."""
    left, out = dict.fromkeys(names), []
    while left:
        free = [n for n in left if not any(r.child == n and r.parent in left for r in references if r.on_delete == CASCADE)]
        if not free:
            raise ValueError(f"relations that cascade in a cycle: {sorted(left)}")
        for n in free:
            out.append(n)
            del left[n]
    return out


def deleted(relations: dict[str, tuple[DataFrame, str]], references: list[Reference], gone: dict[str, DataFrame]) -> DataFrame:
    """Rows (relation, key, outcome, column) of a set of deletes; each row of gone is a delete of its own.

    relations: name to (rows, name of their key); gone: name to rows that have that key's column. A delete removes its row and, over CASCADE,
    those that refer to it, and theirs. If any row refers to one of them over RESTRICT, the delete is refused and does nothing. What other
    deletes remove is removed, whether or not one that is refused would have removed it too. Rows that refer over SET NULL to
    a removed row, and stay, have their column named. Requested keys that aren't there are unknown. Keys are shown as texts.

    Removed rows carry the delete that they belong to from relation to relation, parents first: one equality join a
    reference, each relation's result written once.
    """
    order = parents_first(list(relations), references)
    key_of = {n: k for n, (_, k) in relations.items()}
    asked, hit = [], {}
    for name, rows in gone.items():
        own = rows.select(F.col(key_of[name]).alias("key")).where("key is not null").distinct()
        known = relations[name][0].select(F.col(key_of[name]).alias("key")).distinct().withColumn("known", F.lit(True))
        own, _ = written(own.join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(False))), "asked")
        asked.append((name, own))
    carried: dict[str, DataFrame] = {}
    for name in order:
        rows, key = relations[name]
        parts = [own.where("known").select("key", F.lit(name).alias("root"), F.col("key").cast("string").alias("root_key")) for n, own in asked if n == name]
        for r in references:
            if r.child == name and r.on_delete == CASCADE and r.parent in carried:
                up = carried[r.parent].select(F.col("key").alias("_parent"), "root", "root_key")
                parts.append(rows.select(F.col(key).alias("key"), F.col(r.column).alias("_parent")).join(up, "_parent").drop("_parent"))
        if parts:
            carried[name], _ = written(reduce(DataFrame.unionByName, parts).distinct(), "carried")
    stops = []
    for r in references:
        if r.on_delete == RESTRICT and r.parent in carried:
            held = relations[r.child][0].select(F.col(r.column).alias("key")).where("key is not null").distinct()
            stops.append(carried[r.parent].join(held, "key", "left_semi").select("root", "root_key"))
    roots = "root string, root_key string"
    spark = next(iter(relations.values()))[0].sparkSession
    refused, _ = written(reduce(DataFrame.union, stops).distinct() if stops else spark.createDataFrame([], roots), "refused")
    out = []
    for name, own in carried.items():
        hit[name], _ = written(own.join(refused, ["root", "root_key"], "left_anti").select("key").distinct(), "removed")
        out.append(hit[name].select(F.lit(name).alias("relation"), F.col("key").cast("string").alias("key"), F.lit("removed").alias("outcome"), F.lit(None).cast("string").alias("column")))
    for r in references:
        if r.on_delete == SET_NULL and r.parent in hit:
            rows, key = relations[r.child]
            touched = rows.select(F.col(key).alias("key"), F.col(r.column).alias("_parent")).join(hit[r.parent].withColumnRenamed("key", "_parent"), "_parent", "left_semi").select("key")
            touched = touched.join(hit[r.child], "key", "left_anti") if r.child in hit else touched
            out.append(touched.select(F.lit(r.child), F.col("key").cast("string"), F.lit("nulled"), F.lit(r.column)))
    out.append(refused.select("root", "root_key", F.lit("refused"), F.lit(None).cast("string")))
    out += [own.where("not known").select(F.lit(n), F.col("key").cast("string"), F.lit("unknown"), F.lit(None).cast("string")) for n, own in asked]
    return reduce(DataFrame.union, out).toDF("relation", "key", "outcome", "column")
