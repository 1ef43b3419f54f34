"""Prefix-first search over normalised columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import by_locale
from evidara.operators.containment import containing
from evidara.operators.dedup import first_wins, top_k
from evidara.sources.files import written

CANDIDATES, DEFAULT, MOST = 400, 30, 50


def clamped(limit: int | None) -> int:
    return max(1, min(limit or DEFAULT, MOST))


def any_of(fields: list[str], test) -> Column:
    return reduce(lambda x, y: x | y, [test(F.col(f)) for f in fields])


def ordering(fields: list[str], query: str, tie: list[str]) -> list[Column]:
    """Rows of which a field begins with the query come first, then by the fields' text."""
    begins = F.when(any_of(fields, lambda c: c.startswith(query)), 0).otherwise(1)
    return [begins.asc(), *by_locale(F.concat_ws(" ", *fields)), *[F.col(t).asc() for t in tie]]


def prefix_first(df: DataFrame, fields: list[str], query: str, tie: list[str], limit: int) -> DataFrame:
    """Rows that begin with the query; if there are none, rows that contain it; CANDIDATES at most are ranked.

    One plan, without a look at the first result on the driver.
    """
    order = [F.concat_ws(" ", *fields).asc(), *[F.col(t).asc() for t in tie]]
    begins = df.where(any_of(fields, lambda c: c.startswith(query))).orderBy(*order).limit(CANDIDATES)
    found = begins.agg((F.count("*") > 0).alias("_found"))
    inside = df.where(any_of(fields, lambda c: c.contains(query))).orderBy(*order).limit(CANDIDATES)
    inside = inside.crossJoin(F.broadcast(found)).where("not _found").drop("_found")  # found is one row
    return begins.unionByName(inside).orderBy(*ordering(fields, query, tie)).limit(limit)


def contains(df: DataFrame, fields: list[str], query: str, tie: list[str], limit: int) -> DataFrame:
    order = [F.concat_ws(" ", *fields).asc(), *[F.col(t).asc() for t in tie]]
    some = df.where(any_of(fields, lambda c: c.contains(query))).orderBy(*order).limit(CANDIDATES)
    return some.orderBy(*ordering(fields, query, tie)).limit(limit)


def one_each(found: DataFrame, fields: list[str], query: str, tie: list[str], key: Column, limit: int | None) -> DataFrame:
    """The first row of each key in the order of the search, cut to limit after that if it is named."""
    order = ordering(fields, query, tie)
    one = first_wins(found.withColumn("_key", key), ["_key"], order).drop("_key")
    return one if limit is None else one.orderBy(*order).limit(limit)


def medications(terms: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Names of brands or generics: prefixes, or else parts. terms: id, brand, generic, normalised."""
    return prefix_first(terms, ["brand", "generic"], query, ["id"], clamped(limit))


def brands(terms: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    return contains(terms, ["brand"], query, ["id"], clamped(limit))


def generics(terms: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """The cut comes before names that repeat are left out, so fewer may be left."""
    return one_each(contains(terms, ["generic"], query, ["id"], clamped(limit)), ["generic"], query, ["id"], F.col("generic"), None)


def indications(known: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Names that repeat are left out before the cut. known: id, indication, normalised."""
    return one_each(prefix_first(known, ["indication"], query, ["id"], CANDIDATES), ["indication"], query, ["id"], F.col("indication"), clamped(limit))


def conditions(known: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """By disease, concept or alias; one row an identity, or a disease that has none. known: id, identity, disease, concept, snomed."""
    fields = ["disease", "concept", "snomed"]
    key = F.coalesce(F.nullif("identity", F.lit("")), "disease")
    return one_each(prefix_first(known, fields, query, ["id"], CANDIDATES), fields, query, ["id"], key, clamped(limit))


#: The longest query that is accepted; lengths of queries are prefixes' lengths in the index.
MOST_CHARS = 120


def candidates(queries: DataFrame, rows: DataFrame, fields: list[str], tie: list[str], prefixes: bool = True) -> DataFrame:
    """The first CANDIDATES rows for each different query of queries (query): rows with _ask, the query, besides.

    With prefixes, rows of which a field begins with the query, and for queries without any those that contain it; else those
    that contain it. Rows are keyed by those prefixes of their fields that are as long as some query, and of a prefix the first
    CANDIDATES are kept before queries join it; containment goes to the index of grams. An empty query has the first rows; a null one
    none. tie names rows. No join is without an equality, whatever the number of queries.
    """
    asked = queries.select(F.col("query").alias("_ask")).where("_ask is not null").distinct()
    # A number for each length that occurs.
    lengths = sorted(r[0] for r in asked.select(F.length("_ask")).distinct().collect())
    if lengths and lengths[-1] > MOST_CHARS:
        raise ValueError(f"a query has more than {MOST_CHARS} characters")
    lengths = lengths if prefixes else [n for n in lengths if not n]
    order = [F.concat_ws(" ", *fields).asc(), *[F.col(t).asc() for t in tie]]
    found = []
    for f in fields:
        keys = F.array(*[F.when(F.length(f) >= n, F.substring(f, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
        found.append(top_k(rows.select("*", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("_ask")), ["_ask"], order, CANDIDATES))
    index = reduce(DataFrame.unionByName, found)
    index = top_k(index.dropDuplicates(["_ask", *tie]), ["_ask"], order, CANDIDATES) if len(fields) > 1 else index
    begins, _ = written(asked.join(index, "_ask"), "begins")
    rest, _ = written(asked.where("_ask <> ''").join(begins.select("_ask").distinct(), "_ask", "left_anti"), "rest")
    return begins.unionByName(containing(rest, rows, fields, order, CANDIDATES, tie))


def many(queries: DataFrame, rows: DataFrame, fields: list[str], tie: list[str], limit: int, prefixes: bool = True, key: Column | None = None, key_first: bool = True) -> DataFrame:
    """A search for each of queries (query, ...) in one plan: its columns beside those of rows and rank, from 1.

    Without a key that is prefix_first, or contains if prefixes is false, for each query. With one, the first row of each key counts: keys
    are made single before the cut to limit, or after it if key_first is false, as in the single searches. Each
    different query is answered once.
    """
    begins = F.when(any_of(fields, lambda c: c.startswith(F.col("_ask"))), 0).otherwise(1)
    order = [begins.asc(), *by_locale(F.concat_ws(" ", *fields)), *[F.col(t).asc() for t in tie]]
    found = candidates(queries, rows, fields, tie, prefixes)
    if key is not None and not key_first:
        found = top_k(found, ["_ask"], order, limit)
    if key is not None:
        found = first_wins(found.withColumn("_key", key), ["_ask", "_key"], order).drop("_key")
    best = top_k(found, ["_ask"], order, limit, "rank")
    return queries.join(best.withColumnRenamed("_ask", "query"), "query")


def many_medications(queries: DataFrame, terms: DataFrame, limit: int | None = None) -> DataFrame:
    return many(queries, terms, ["brand", "generic"], ["id"], clamped(limit))


def many_brands(queries: DataFrame, terms: DataFrame, limit: int | None = None) -> DataFrame:
    return many(queries, terms, ["brand"], ["id"], clamped(limit), prefixes=False)


def many_generics(queries: DataFrame, terms: DataFrame, limit: int | None = None) -> DataFrame:
    return many(queries, terms, ["generic"], ["id"], clamped(limit), prefixes=False, key=F.col("generic"), key_first=False)


def many_indications(queries: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    return many(queries, known, ["indication"], ["id"], clamped(limit), key=F.col("indication"))


def many_conditions(queries: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    return many(queries, known, ["disease", "concept", "snomed"], ["id"], clamped(limit), key=F.coalesce(F.nullif("identity", F.lit("")), "disease"))
