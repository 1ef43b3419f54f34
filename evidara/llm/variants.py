"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so that words of the same letters share it. Taking a letter away
takes its power from the key: a word and the one that has a letter more agree in the key of the shorter, two words that
differ in one letter agree once each has lost its own. These are equality joins of keys; half of the word, which one edit leaves as it
was, is joined on too, so that anagrams don't all meet; then the order of letters is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.runtime import remove, table, written

LEAST_LENGTH, LEAST_N = 7, 2
#: A near word is a word's form if it occurs this many times as often.
TIMES = 10
#: Of runs whose hash this divides, a letter is deleted.
DELETED = 31
#: The power of a letter's code point in a key.
POWER = 5
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """Rows (word, n) of docs (doc_id, text): runs of letters, A-Z lower-cased, one letter deleted from those that the hash picks.

    Runs shorter than least_length can't become words of that length and aren't made rows of. Counts are summed
    in each task before words move.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select(F.translate("run", UPPER, LOWER).alias("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    made = runs.select(F.when(F.col("h") % DELETED == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def power(letter: Column) -> Column:
    """The code point to the power of POWER, as a long."""
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def keyed(listed: DataFrame) -> DataFrame:
    """listed (word, ...) with size, letters, and key: the sum of the letters' powers."""
    rows = listed.withColumns({"size": F.length("word"), "letters": F.split("word", "")})
    return rows.withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: s + power(c)))


def halves(size: Column) -> Column:
    """The two parts of a word that one edit can't both touch: its beginning, half of `size` long, and the rest; marked apart."""
    half = F.floor(size / 2).cast("int")
    first = F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), half))
    last = F.concat(F.lit(">"), F.substring(F.col("word"), F.length("word") - (size - half) + 1, size))
    return F.explode(F.array(first, last)).alias("half")


def near_pairs(listed: DataFrame) -> DataFrame:
    """Rows (a, n_a, b, n_b): each pair of words of listed (word, n) that differ by exactly one inserted, deleted or replaced letter, once."""
    rows = keyed(listed)
    # With one letter less: the key that a shorter word has, or another word that lost a letter.
    letter = rows.select("word", "n", "size", "key", F.explode(F.array_distinct("letters")).alias("letter"))
    less = letter.select("word", "n", "size", (F.col("key") - power(F.col("letter"))).alias("key"), "letter")
    side = lambda df, x, *more: df.select(F.col("word").alias(x), F.col("n").alias(f"n_{x}"), "size", "key", "half", *more)
    # A word of a letter more: its halves are those of the shorter size.
    longer = less.select("word", "n", (F.col("size") - 1).alias("size"), "key").select("*", halves(F.col("size")))
    shorter = rows.select("word", "n", "size", "key").select("*", halves(F.col("size")))
    added = side(longer, "a").join(side(shorter, "b"), ["size", "key", "half"])
    # An insertion between the halves leaves both as they were: it is kept where the beginnings meet.
    begins = F.substring(F.col("a"), F.lit(1), F.floor(F.col("size") / 2).cast("int")) == F.substring(F.col("b"), F.lit(1), F.floor(F.col("size") / 2).cast("int"))
    added = added.where(F.col("half").startswith("<") | ~begins)
    other = less.select("*", halves(F.col("size")))
    changed = side(other, "a", F.col("letter").alias("lost")).join(side(other, "b", F.col("letter").alias("got")), ["size", "key", "half"])
    changed = changed.where("a < b and lost <> got")
    pairs = added.select("a", "n_a", "b", "n_b").union(changed.select("a", "n_a", "b", "n_b"))
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for forms (word, form), in which no chain returns: each word's last form, by doubling of steps."""
    spark = forms.sparkSession
    now, path = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after, new = written(after, "roots")
        remove(spark, path)
        now, path = after, new
    return now.select("word", "root")


def grouped(listed: DataFrame, times: int = TIMES) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for listed (word, n), whose words are different.

    n_near counts a word's near words. form is the near word that occurs most (of equal ones the smallest in code-point order), if
    that is `times` as often as the word itself; root is what following forms ends at, the word itself without a form. As
    a form occurs more than its word, no chain returns. A word that very many are near to is counted in parts. An empty
    table gives none; a null word is left out.
    """
    listed, _ = written(listed.where("word is not null").select("word", "n"), "words")
    pairs = near_pairs(listed)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_near")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), F.col("near"))).alias("best"))
    own = listed.join(best, "word", "left")
    formed = -F.col("best.less") >= times * F.col("n")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    own, _ = written(own, "forms")
    last = roots(own.where("form is not null").select("word", "form"))
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """grouped words of docs (doc_id, text). Null texts have none; a null doc_id is hashed as an empty one; repeated rows count; other columns take no part."""
    return grouped(words(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the spelling variants of all documents."""
    return variants(table(spark, sf_dir, "documents"))
