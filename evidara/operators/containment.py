"""Containment by an index of character grams: equality joins find what may contain a text, `contains` verifies it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.dedup import top_k
from evidara.sources.files import shuffled, written

GRAM = 3


def grams(c: Column, size: int) -> Column:
    """The different substrings of c of `size` characters; none of shorter ones."""
    last = F.length(c) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing_texts(asks: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (_ask, _text): the texts of texts (_text) that contain each of asks (_ask), for asks of more than GRAM characters.

    The rarest of an ask's grams is the key of the join: a text that contains the ask has all its grams. An ask with a
    gram that no text has meets none.
    """
    posting = texts.where(F.length("_text") > GRAM).select("_text", F.explode(grams(F.col("_text"), GRAM)).alias("_gram"))
    held = posting.groupBy("_gram").agg(F.count("*").alias("_n"))
    wanted = asks.where(F.length("_ask") > GRAM).select("_ask", F.explode(grams(F.col("_ask"), GRAM)).alias("_gram"))
    counted = shuffled(wanted).join(held, "_gram", "left").groupBy("_ask").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("rarest"))
    rarest = counted.where("rarest.n > 0").select("_ask", F.col("rarest.gram").alias("_gram"))
    return rarest.join(shuffled(posting), "_gram").where(F.col("_text").contains(F.col("_ask"))).select("_ask", "_text")


def containing(asks: DataFrame, rows: DataFrame, fields: list[str], order: list[Column], k: int, ids: list[str]) -> DataFrame:
    """The first k rows in the order of which a field contains _ask, for each of asks (_ask): rows with _ask besides.

    asks are different and not empty. ids name rows. Of rows that share a text the first k stand for it. Asks of up to GRAM
    characters are grams themselves: of each gram the first k rows are kept before any ask is joined to it, so a gram that very
    many texts have costs what k rows do. Without any ask, which is looked at first, nothing is indexed.
    """
    if asks.isEmpty():
        return rows.withColumn("_ask", F.lit(None).cast("string")).where("false")
    found = []
    for field in fields:
        best, _ = written(top_k(rows.where(F.col(field) != "").withColumn("_text", F.col(field)), ["_text"], order, k), "texts")
        short = F.explode(F.concat(*[grams(F.col("_text"), n) for n in range(1, GRAM + 1)])).alias("_ask")
        of_gram = top_k(best.select("*", short), ["_ask"], order, k)
        found.append(asks.where(F.length("_ask") <= GRAM).join(shuffled(of_gram), "_ask").drop("_text"))
        pairs = containing_texts(asks, best.select("_text").distinct())
        found.append(pairs.join(shuffled(best), "_text").drop("_text"))
    both = reduce(DataFrame.unionByName, found)
    both = both.dropDuplicates(["_ask", *ids]) if len(fields) > 1 else both
    return top_k(both, ["_ask"], order, k)
