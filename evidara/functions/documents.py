"""Records without a declared schema, as variants: parsed, looked into, changed, and written back as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import col


def parsed(c: Column | str) -> Column:
    """A JSON text of any shape as a variant; null where it isn't JSON."""
    return F.try_parse_json(col(c))


def at(c: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b[0]); null where the path leads nowhere, or to a value that isn't of that kind."""
    return F.try_variant_get(col(c), path, kind)


def shape(c: Column | str) -> Column:
    """The value's type as Spark names it, with its fields'."""
    return F.schema_of_variant(col(c))


def is_object(c: Column | str) -> Column:
    return F.coalesce(shape(c).startswith("OBJECT"), F.lit(False))


def without(c: Column | str, *fields: str) -> Column:
    """The record without top-level fields, the rest as it was; a value that isn't a record stays."""
    held = col(c).cast("map<string, variant>")
    left = F.map_filter(held, lambda k, _: ~k.isin(*fields))
    return F.when(is_object(c), F.to_variant_object(left)).otherwise(col(c))


def written(c: Column | str) -> Column:
    """A variant as JSON text, fields in the order of their names."""
    return F.to_json(col(c))
