"""Stable hashes of records, and numbers drawn from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import col


def stable_hash(*fields: Column | str) -> Column:
    """sha256 of the JSON object of fields in this order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def text_hash(c: Column | str) -> Column:
    """sha256 of the JSON string of c."""
    return F.sha2(F.regexp_replace(F.to_json(F.struct(col(c).alias("v"))), r'^\{"v":|\}$', ""), 256)


def drawn(hex_hash: Column, low: int, high: int) -> Column:
    """A whole number from low to high, by the first eight hexadecimal digits of a hash."""
    return F.lit(low) + F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("bigint") % (high - low + 1)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)
