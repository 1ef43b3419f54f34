"""Ordinal domains: severities, assessments, roll-ups and regex tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import col

# Orders of the domains, labels and patterns of relationships, states of records.
SEVERITY = {"NOT_EVALUATED": 0, "MINOR": 1, "MODERATE": 2, "MAJOR": 3}
ASSESSMENT = {"NOT_EVALUATED": 0, "LOW": 1, "MODERATE": 2, "HIGH": 3}
RANKING = {"LOW": 0, "NOT_EVALUATED": 1, "MODERATE": 2, "HIGH": 3}
TIERS = (("contraindicat|avoid", "HIGH"), ("warning|caution|not recommended", "MODERATE"), ("precaution|monitor", "LOW"))
INDICATION = "indicat|treat|therapy|used for"
MEDICATION_STATUS = {"active": "ACTIVE", "on-hold": "ON_HOLD", "discontinued": "DISCONTINUED"}


def rank(c: Column | str, order: dict[str, int]) -> Column:
    """The value's place in the order; values outside it, and null, count as the lowest."""
    known = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return F.coalesce(known[col(c)], F.lit(min(order.values())))


def label(r: Column | str, order: dict[str, int]) -> Column:
    back = F.create_map(*[F.lit(x) for k, v in order.items() for x in (v, k)])
    return back[F.coalesce(col(r), F.lit(min(order.values())))]


def highest(c: Column | str, order: dict[str, int]) -> Column:
    """Aggregate: the highest label of a group; of none, the lowest."""
    return label(F.max(rank(c, order)), order)


def overall(severity: Column | str, assessment: Column | str) -> Column:
    """The assessment that an interaction severity and a disease assessment make together."""
    s, a = rank(severity, SEVERITY), rank(assessment, ASSESSMENT)
    return label(F.greatest(s, a), ASSESSMENT)


def tier(relationship: Column | str) -> Column:
    """The assessment of a relationship's wording, first pattern first; null without a match."""
    text = F.lower(col(relationship))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(TIERS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def is_indication(relationship: Column | str, strict: bool = False) -> Column:
    """Whether the wording is an indication. A contraindication contains one; strict leaves it out."""
    text = F.lower(col(relationship))
    return text.rlike(INDICATION) & ~text.contains("contraindicat") if strict else text.rlike(INDICATION)


def status_code(c: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDICATION_STATUS.items() for x in pair])
    return F.coalesce(known[F.lower(col(c))], F.lit("ACTIVE"))


def status_name(c: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in MEDICATION_STATUS.items() for x in (v, k)])
    return F.coalesce(known[col(c)], F.lit("active"))


def risk_category(score: Column | str) -> Column:
    return F.when(col(score) >= 61, "High").when(col(score) >= 31, "Moderate").otherwise("Low")
