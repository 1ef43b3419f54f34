"""A deterministic placeholder for a risk model: no inference, for demonstration only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.hashing import drawn, half_up, text_hash
from evidara.functions.ordinal import risk_category

# The formula's base, cap, weights and ranges.
BASE, CAP, PER_MEDICINE, YEARS = 8, 78, 7, 6
SCORE, CONFIDENCE = (0, 18), (66, 91)
TYPE = "adr-demo-confidence"


def predicted(df: DataFrame, drug: str, age: str, n_medicines: str) -> DataFrame:
    """df with risk, category, confidence, lower and upper."""
    score = drawn(text_hash(drug), *SCORE)
    risk = F.least(F.lit(float(CAP)), F.lit(BASE) + F.col(n_medicines) * PER_MEDICINE + F.col(age) / YEARS + score)
    named = F.to_json(F.struct(F.col(drug).alias("candidate"), F.lit(TYPE).alias("type")))
    confidence: Column = drawn(F.sha2(named, 256), *CONFIDENCE)
    out = df.withColumns({"_risk": risk, "confidence": confidence})
    width = F.greatest(F.lit(3), half_up((100 - F.col("confidence")) / 2))
    return out.withColumns({
        "risk": half_up(F.col("_risk")), "category": risk_category("_risk"), "lower": F.greatest(F.lit(0), half_up(F.col("_risk") - width)), "upper": F.least(F.lit(100), half_up(F.col("_risk") + width)),
    }).drop("_risk")


@dataclass(frozen=True)
class Provider:
    """A source of predictions: a name, and a function that adds a column risk to a table of cases."""

    name: str
    predict: Callable[[DataFrame], DataFrame]


def asked(cases: DataFrame, providers: list[Provider]) -> DataFrame:
    """The cases once for each provider, with its name and its risk."""
    found = [p.predict(cases).select(*cases.columns, "risk").withColumn("provider", F.lit(p.name)) for p in providers]
    return reduce(DataFrame.unionByName, found)
