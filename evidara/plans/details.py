"""Nested records of patients and consultations, their display, snapshots of results, and the audit log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import collapsed, col, first_filled
from evidara.operators.dedup import latest, sequence
from evidara.operators.merge import upsert


def newest_first(children: DataFrame, key: str, at: str, tie: str, name: str) -> DataFrame:
    """Rows (key, name): the children of each key as an array, the newest first. A record's children are few: input bounds them."""
    rest = [c for c in children.columns if c not in (key, at, tie)]
    held = F.sort_array(F.collect_list(F.struct(at, tie, *rest)), asc=False)
    return children.groupBy(key).agg(held.alias(name))


def status_shown(c: Column | str) -> Column:
    return F.replace(F.lower(col(c)), F.lit("_"), F.lit("-"))


def patients(people: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """people (id, ...) with an array column for each of children (patient, id, created_at, ...), the newest first, empty without any."""
    out = people
    for name, rows in children.items():
        rows = rows.withColumn("status", status_shown("status")) if "status" in rows.columns else rows
        out = out.join(newest_first(rows, "patient", "created_at", "id", name).withColumnRenamed("patient", "id"), "id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def consultations(visits: DataFrame, notes: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """visits (id, status, ...) with latest_note (a struct, or null) and follow_ups (an array, the newest first)."""
    last = latest(notes, ["consultation"], "created_at", "id").select(F.col("consultation").alias("id"), F.struct("id", "created_at").alias("latest_note"))
    more = newest_first(follow_ups, "consultation", "created_at", "id", "follow_ups").withColumnRenamed("consultation", "id")
    out = visits.withColumn("status", status_shown("status")).join(last, "id", "left").join(more, "id", "left")
    return out.withColumn("follow_ups", F.coalesce("follow_ups", F.array()))


def public_ids(rows: DataFrame, owner: list[str], key: str) -> DataFrame:
    """public_id: the number of a row among its owner's, and four hexadecimal digits of its key's hash in place of random ones."""
    digits = F.upper(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 4))
    numbered = sequence(rows, owner, [F.col(key).asc()])
    return numbered.withColumn("public_id", F.concat_ws("-", F.lit("P"), F.lpad(F.col("number").cast("string"), 4, "0"), digits))


def shown_date(c: Column | str) -> Column:
    return F.date_format(col(c), "d MMM yyyy")


def as_text(fields: dict[str, Column]) -> Column:
    """A line "name: value" for each field that is filled."""
    lines = [F.when(first_filled(v).isNotNull(), F.concat(F.lit(f"{name}: "), v)) for name, v in fields.items()]
    return F.concat_ws("\n", *lines)


def as_medicines(visits: DataFrame, key: str, entered: str, generic: str) -> DataFrame:
    """Prescriptions of earlier visits as records of medicines."""
    return visits.select(F.col(key).alias("medicine"), F.col(entered).alias("entered"), F.col(generic).alias("generic"), F.lit("ACTIVE").alias("status"), F.lit("prior-visit").alias("source"))


def listed(rows: DataFrame, fields: list[str], query: str | None, equal: dict[str, object]) -> DataFrame:
    """Rows whose fields, joined by spaces, contain the query in any case, and whose columns have the values that are given; what isn't given filters nothing."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    if query and query.strip():
        tests.append(F.lower(F.concat_ws(" ", *fields)).contains(F.lower(collapsed(F.lit(query)))))
    return rows.where(reduce(lambda x, y: x & y, tests, F.lit(True)))


def audit(rows: DataFrame, actor: Column, action: str, entity: str, key: Column, at: Column) -> DataFrame:
    """Rows of an audit log, to be appended."""
    return rows.select(actor.alias("actor"), F.lit(action).alias("action"), F.lit(entity).alias("entity"), key.alias("entity_id"), at.alias("at"))


def stored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots (consultation, engine, input_hash, result, stored_at): a result of the same consultation, engine and input is replaced."""
    return upsert(old, new, ["consultation", "engine", "input_hash"], [F.col("stored_at").desc()])


def shown(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each consultation."""
    return latest(snapshots, ["consultation"], "stored_at", "engine")
