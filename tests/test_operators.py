from evidara.operators import dedup, joins, merge, search
from evidara.sources import files
from pyspark.sql import functions as F


def test_first_wins_is_by_order(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 3, "c")], "k string, line int, v string")
    assert sorted(r.v for r in dedup.first_wins(df, ["k"], [F.col("line").asc()]).collect()) == ["a", "c"]


def test_union_equi_join_is_an_or_join(spark):
    a = spark.createDataFrame([(1, "x", "y"), (2, "z", None)], "i int, p string, q string")
    b = spark.createDataFrame([(10, "x", "y"), (11, "z", "y"), (12, None, None)], "j int, r string, s string")
    got = {(r.i, r.j) for r in joins.union_equi_join(a, b, [("p", "r"), ("q", "s")], "i", "j").collect()}
    assert got == {(r.i, r.j) for r in a.join(b, (F.col("p") == F.col("r")) | (F.col("q") == F.col("s"))).collect()}
    plan = joins.union_equi_join(a, b, [("p", "r"), ("q", "s")], "i", "j")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def test_tiered_lookup(spark):
    rows = spark.createDataFrame([(1, "dolo 650"), (2, "metformin"), (3, "dolo"), (4, "")], "i int, name string")
    terms = spark.createDataFrame([(1, "dolo 650", "paracetamol")], "t int, brand string, generic string")
    got = joins.tiered_lookup(rows, terms, "i", [("name", "brand"), ("name", "generic")], [("name", "brand")], [F.col("t")])
    assert sorted((r.i, r.generic, r.tier) for r in got.collect()) == [(1, "paracetamol", 1), (2, None, None), (3, "paracetamol", 2), (4, None, None)]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, v int, made int")
    new = spark.createDataFrame([("b", 9, 7), ("b", 8, 8), ("c", 3, 9)], "k string, v int, made int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merge.insert_ignore(old, new, ["k"], [F.col("v").asc()])) == [("a", 1, 5), ("b", 2, 6), ("c", 3, 9)]
    up = merge.upsert(old, new, ["k"], [F.col("v").desc()], ["made"])
    assert rows(up) == [("a", 1, 5), ("b", 9, 6), ("c", 3, 9)]
    assert rows(merge.upsert(up, new, ["k"], [F.col("v").desc()], ["made"])) == rows(up)
    assert rows(merge.replace_collection(old, new, "k")) == [("a", 1, 5), ("b", 8, 8), ("b", 9, 7), ("c", 3, 9)]


def test_search_falls_back_to_contains(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["red gear", "gear red", "blue"])], "i int, n string")
    assert [r.n for r in search.prefix_first(df, ["n"], "red", ["i"], 9).collect()] == ["red gear"]
    assert [r.n for r in search.prefix_first(df, ["n"], "ear", ["i"], 9).collect()] == ["gear red", "red gear"]
    assert search.prefix_first(df, ["n"], "zzz", ["i"], 9).count() == 0
    assert (search.clamped(None), search.clamped(0), search.clamped(99)) == (30, 30, 50)


def test_csv_and_dump(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,a,id2,b,level\n1,"X, ""y""",2,Z, major \n\n3,,4,Q,Unknown\n')
    got = files.csv(spark, str(tmp_path), files.INTERACTIONS).collect()
    assert [r.drug_a for r in got] == ['X, "y"', None]
    (tmp_path / "d.sql").write_text("COPY public.t (a, b) FROM stdin;\n1\t\\N\n2\tx\n\\.\nnoise\nCOPY u (a) FROM stdin;\n7\n\\.\n")
    rows = files.dump_sections(spark, str(tmp_path / "d.sql"))
    assert [(r.a, r.b) for r in files.picked(rows, "t", {"a": 0, "b": 1}).collect()] == [("1", None), ("2", "x")]
    assert [r.a for r in files.picked(rows, "u", {"a": 0}).collect()] == ["7"]


def test_ndjson(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, v string")
    files.write_ndjson(df, str(tmp_path / "x"))
    assert sorted(tuple(r) for r in files.ndjson(spark, str(tmp_path / "x"), "i int, v string").collect()) == [(1, "a"), (2, None)]
    assert files.optional(spark, str(tmp_path / "none"), "i int").count() == 0
