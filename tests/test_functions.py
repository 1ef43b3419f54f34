from evidara.functions import hashing, ordinal, text, validation
from pyspark.sql import functions as F


def one(spark, expr, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    return df.select(expr.alias("v")).head().v


def test_terms(spark):
    rows = [("Paracetamol",), ("Paracetamol/Acetaminophen + Tramadol",), (None,), ("---",)]
    got = [r.v for r in spark.createDataFrame(rows, "x string").select(text.ingredient_terms("x").alias("v")).collect()]
    assert got == [["acetaminophen"], ["acetaminophen", "tramadol"], [], []]


def test_normalisation_is_idempotent(spark):
    rows = [("  Co-Trimoxazole (800mg) ",), ("é!",), ("",)]
    df = spark.createDataFrame(rows, "x string").select(text.term("x").alias("t"))
    assert [r.t for r in df.collect()] == ["co trimoxazole 800mg", "", ""]
    assert df.where(text.term("t") != F.col("t")).count() == 0


def test_codes(spark):
    assert one(spark, text.concept_code("x"), x=" umls:c1234567") == "C1234567"
    assert one(spark, text.concept_code("x"), x="C123456") is None
    assert one(spark, text.identity("c", "v", "d"), c="", v="1", d="Chronic Kidney") == "DRUGCENTRAL:1:chronic kidney"


def test_tiers_and_quirk(spark):
    rows = [("contraindication",), ("indication",), ("off-label use",), ("symptomatic treatment",), ("precaution",), ("caution",)]
    got = spark.createDataFrame(rows, "x string").select(ordinal.tier("x").alias("t"), ordinal.is_indication("x").alias("i"), ordinal.is_indication("x", True).alias("s")).collect()
    assert [r.t for r in got] == ["HIGH", None, None, None, "MODERATE", "MODERATE"]
    assert [r.i for r in got] == [True, True, False, True, False, False]
    assert [r.s for r in got] == [False, True, False, True, False, False]


def test_roll_up_ignores_unknown(spark):
    df = spark.createDataFrame([("a", "MINOR"), ("a", "strange"), ("b", None)], "k string, v string")
    assert {r.k: r.v for r in df.groupBy("k").agg(ordinal.highest("v", ordinal.SEVERITY).alias("v")).collect()} == {"a": "MINOR", "b": "NOT_EVALUATED"}


def test_hash_keeps_nulls(spark):
    import hashlib

    want = hashlib.sha256(b'{"a":null,"b":"x"}').hexdigest()
    assert one(spark, hashing.stable_hash(F.lit(None).cast("string").alias("a"), F.col("x").alias("b")), x="x") == want


def test_quarantine(spark):
    df = spark.createDataFrame([("Ann", "2d", 30), ("9", "5d", 131), (None, None, None)], "name string, f string, age int")
    rules = {"name": validation.matches("name", validation.NAME), "frequency": validation.matches("f", validation.FREQUENCY), "age": validation.within("age", validation.AGE)}
    good, bad = validation.quarantine(df, rules)
    assert good.count() == 1
    assert [r.errors for r in bad.collect()] == [["name", "frequency", "age"]] * 2


