"""Row validation: rules as named conditions, violations as an array of names, bad rows set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import col, first_filled, trimmed

# Patterns and bounds of accepted input.
NAME = r"^[A-Za-z][A-Za-z .'-]*$"
FREQUENCY = r"(?i)^(1d|2d|3d|1w|2w|3w)$"
PASSWORD = (r"[A-Za-z]", r"\d", r"[^A-Za-z0-9]")
AGE = (0, 130)
DURATION_DAYS = (0, 3650)
MOST_ITEMS = 100


def filled(c: Column | str, most: int) -> Column:
    """A text of 1 to most characters after trimming."""
    return F.coalesce(F.length(trimmed(c)).between(1, most), F.lit(False))


def matches(c: Column | str, pattern: str) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def within(c: Column | str, bounds: tuple[int, int]) -> Column:
    return F.coalesce(col(c).try_cast("int").between(*bounds), F.lit(False))


def strong(c: Column | str) -> Column:
    """A password of 8 to 128 characters with every kind of PASSWORD."""
    kinds = [matches(c, p) for p in PASSWORD]
    return F.coalesce(F.length(col(c)).between(8, 128), F.lit(False)) & kinds[0] & kinds[1] & kinds[2]


def few(c: Column | str, most: int = MOST_ITEMS) -> Column:
    """A list of at most `most` items; a null list is empty."""
    return F.coalesce(F.size(col(c)), F.lit(0)) <= most


def any_filled(*columns: Column | str) -> Column:
    return first_filled(*columns).isNotNull()


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order."""
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def quarantine(df: DataFrame, rules: dict[str, Column], errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the names of broken rules)."""
    checked = df.withColumn(errors, violations(rules))
    return checked.where(F.size(errors) == 0).drop(errors), checked.where(F.size(errors) > 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that aren't unique, with their numbers of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose foreign key has no parent."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")
