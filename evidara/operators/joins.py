"""Joins: disjunctions as unions of equi-joins, tiered lookups, pairs, nested children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.containment import containing
from evidara.operators.dedup import first_wins
from evidara.sources.files import written


def union_equi_join(left: DataFrame, right: DataFrame, arms: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """left join right on any of the arms (left column = right column); a pair that several arms find comes once.

    Each arm is a hash or merge join; a condition with OR would compare every pair of rows. left_id and
    right_id name rows; columns of the two sides don't share names.
    """
    found = reduce(DataFrame.union, [left.select(left_id, F.col(a).alias("_key")).join(right.select(right_id, F.col(b).alias("_key")), "_key").select(left_id, right_id) for a, b in arms])
    return found.distinct().join(left, left_id).join(right, right_id)


def tiered_lookup(rows: DataFrame, terms: DataFrame, row_id: str, exact: list[tuple[str, str]], part_of: list[tuple[str, str]], order: list[Column]) -> DataFrame:
    """Each row with its best term: by equality on any of exact; only rows without one by containment on part_of; else none.

    order decides among terms and is total. Every different text is looked up once, however many rows ask it, and each equality
    has one best term for a key, so no arm gives more rows than there are texts. Containment goes through an index of
    character grams: no arm is without an equality.
    """
    asks = list(dict.fromkeys(a for a, _ in [*exact, *part_of]))
    asked = rows.select(*asks).distinct().withColumn("_asked", F.to_json(F.struct(*asks), {"ignoreNullFields": "false"}))
    arms = [asked.select("_asked", F.col(a).alias("_key")).join(first_wins(terms.withColumn("_key", F.col(b)), ["_key"], order), "_key").drop("_key") for a, b in exact]
    tier1 = first_wins(reduce(DataFrame.union, arms), ["_asked"], order).withColumn("tier", F.lit(1))
    rest, _ = written(asked.join(tier1.select("_asked"), "_asked", "left_anti"), "asked")
    inside = []
    for a in dict.fromkeys(a for a, _ in part_of):
        texts = rest.select(F.col(a).alias("_ask")).where("_ask <> ''").distinct()
        held = containing(texts, terms, [b for x, b in part_of if x == a], order, 1, terms.columns)
        inside.append(rest.select("_asked", F.col(a).alias("_ask")).join(held, "_ask").drop("_ask"))
    found = tier1
    if inside:
        found = tier1.unionByName(first_wins(reduce(DataFrame.unionByName, inside), ["_asked"], order).withColumn("tier", F.lit(2)))
    return rows.withColumn("_asked", F.to_json(F.struct(*asks), {"ignoreNullFields": "false"})).join(found, "_asked", "left").drop("_asked")


#: Rows of the shorter side of a product.
MOST_PAIRED = 10_000


def paired(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Every pair of rows that `on` allows, where no equality helps: right is a short reference list, which is counted and sent."""
    if right.limit(MOST_PAIRED + 1).count() > MOST_PAIRED:
        raise ValueError(f"the right side of a product has more than {MOST_PAIRED} rows")
    right = F.broadcast(right)
    return left.crossJoin(right).where(on) if on is not None else left.crossJoin(right)


def nest_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with an array of their children's fields, ordered by them; empty without any."""
    held = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(held, key, "left").withColumn(name, F.coalesce(name, F.array()))
