"""Loading of knowledge: from raw interaction and terminology files and a database dump to clean, versioned relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import ordinal, text
from evidara.operators.dedup import first_wins
from evidara.operators.merge import loaded, without
from evidara.sources import files
from evidara.sources.files import picked


def interactions(raw: DataFrame, source: str, version: str) -> DataFrame:
    """Clean interactions of raw rows (drug_a, drug_b, level, file, line): both names, a known level, one row a pair and level."""
    level = F.upper(F.trim("level"))
    rows = raw.withColumns({"level": level, "x": text.term("drug_a"), "y": text.term("drug_b")})
    rows = rows.where(F.col("level").isin("MAJOR", "MODERATE", "MINOR") & text.first_filled("drug_a").isNotNull() & text.first_filled("drug_b").isNotNull())
    rows = rows.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    rows = first_wins(rows, ["a", "b", "level"], [F.col("file").asc(), F.col("line").asc()])
    return rows.select("drug_a", "drug_b", "a", "b", F.col("level").alias("severity"), F.lit(source).alias("source"), F.lit(version).alias("version"), "file", "line")


def purged(rows: DataFrame, *columns: str, source: str | None = None) -> DataFrame:
    """Rows without the dump's mark of null in any of the columns; of one source only, if it is named: others' rows stay as they are."""
    marked = reduce(lambda x, y: x | y, [F.coalesce(F.col(c) == "\\N", F.lit(False)) for c in columns])
    return without(rows, marked if source is None else marked & (F.col("source") == source))


def loaded_interactions(clean: DataFrame) -> DataFrame:
    """One severity a pair, source and version: the first one loaded, not the highest."""
    return first_wins(clean, ["a", "b", "source", "version"], [F.col("file").asc(), F.col("line").asc()])


def terminology(raw: DataFrame, brand: str, salt: str, source: str, version: str) -> DataFrame:
    """Clean brands with their generic names, the first row of a pair of normalised names."""
    rows = raw.where(text.first_filled(brand).isNotNull() & text.first_filled(salt).isNotNull())
    rows = rows.select(F.trim(brand).alias("brand"), text.generic_name(salt).alias("generic"), "file", "line")
    rows = rows.withColumns({"normalised_brand": text.term("brand"), "normalised_generic": text.term("generic")})
    rows = first_wins(rows, ["normalised_brand", "normalised_generic"], [F.col("file").asc(), F.col("line").asc()])
    return rows.select("brand", "normalised_brand", "generic", "normalised_generic", F.lit(source).alias("source"), F.lit(version).alias("version"))


def relationships(dump: DataFrame, version: str) -> DataFrame:
    """Relationship rows of a dump with the names of their drugs; of names for one id the last counts."""
    names = picked(dump, "structures", {"struct_id": 0, "generic": 9}).where("struct_id is not null and generic is not null")
    names = first_wins(names, ["struct_id"], [F.col("file").desc(), F.col("line").desc()]).select("struct_id", "generic")
    rows = picked(dump, "omop_relationship", {"struct_id": 1, "relationship": 3, "concept": 4, "cui": 5, "snomed": 6})
    rows = rows.join(names, "struct_id").withColumn("disease", F.coalesce("snomed", "concept")).where("disease is not null and relationship is not null")
    return rows.withColumns({"evidence": text.evidence("relationship", "concept", "cui"), "drug": text.term("generic"), "version": F.lit(version)})


def diseases(rows: DataFrame) -> DataFrame:
    """Assessed relationships with the identity of their disease."""
    out = rows.withColumn("assessment", ordinal.tier("relationship")).where("assessment is not null")
    return out.select("generic", "drug", text.identity("cui", "version", "disease").alias("identity"), text.term("disease").alias("disease"), text.term(F.coalesce("concept", F.lit(""))).alias("concept"), text.term(F.coalesce("snomed", F.lit(""))).alias("snomed"), "cui", "relationship", "assessment", "evidence", "version")


def indications(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Indications; without strict, contraindications are among them, as their wording contains the other."""
    out = rows.where(ordinal.is_indication("relationship", strict))
    return out.select(text.term("disease").alias("indication"), F.col("generic").alias("drug"), F.col("drug").alias("normalised"), "relationship", "evidence", "version")


#: The relations of knowledge: the NDJSON file that each is loaded from, its columns, its key, and whether a load replaces rows.
RELATIONS = {
    "terminology": ("terminology.ndjson", "brand string, normalised_brand string, generic string, normalised_generic string, source string, version string", ["brand", "generic"], False),
    "interactions": ("interactions.ndjson", "drug_a string, drug_b string, a string, b string, severity string, source string, version string", ["a", "b", "source", "version"], False),
    "diseases": ("drug-disease.ndjson", "generic string, drug string, identity string, disease string, concept string, snomed string, cui string, relationship string, assessment string, evidence string, source string, version string", ["drug", "disease", "relationship", "source", "version"], True),
    "indications": ("drug-indications.ndjson", "indication string, drug string, normalised string, relationship string, evidence string, source string, version string", ["normalised", "indication", "source", "version"], False),
}
#: Relations whose files a load can't do without.
NEEDED = ("terminology", "interactions")


def import_all(spark: SparkSession, folder: str, old: dict[str, DataFrame], source: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the four relations after a load of a folder of NDJSON files, rows (relation, processed, inserted)).

    Files of NEEDED must be there, others may be missing and load nothing. Rows of diseases of `source` that still have the dump's mark
    of null are purged before the load. Of rows of one key the first in the order of all columns counts.
    """
    for name in NEEDED:
        files.required(spark, f"{folder}/{RELATIONS[name][0]}")
    after, counts = {}, []
    for name, (file, schema, keys, replace) in RELATIONS.items():
        before = purged(old[name], "disease", "cui", "snomed", source=source) if name == "diseases" else old[name]
        new = files.optional(spark, f"{folder}/{file}", schema)
        order = [F.col(c).asc_nulls_last() for c in new.columns]
        after[name], n = loaded(before, new, keys, order, name, replace)
        counts.append(n)
    return after, reduce(DataFrame.union, counts)
