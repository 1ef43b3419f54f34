"""Ordered changes, windows from first events, deletes, loads, variants, and streams."""

import gzip
import random

import pytest
from evidara.functions import documents
from evidara.operators import containment, dedup, deletes, folds, joins, merge, search
from evidara.plans import knowledge
from evidara.sources import files
from evidara.streaming import rates, tables, windows
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_changes_take_their_turn(spark):
    old = spark.createDataFrame([("a", 1), ("b", 5)], "k string, version long")
    new = [("a", 1, 1), ("a", 2, 1), ("a", 3, None), ("a", 4, 3), ("a", 5, 0), ("b", 1, 9), ("c", 1, None), ("c", 2, 1), ("c", 3, 1)]
    changes = spark.createDataFrame(new, "k string, at int, expected long").repartition(3)
    got = {(r.k, r.at): (r.outcome, r.new_version) for r in folds.ordered_changes(old, changes, "k", [F.col("at").asc()]).collect()}
    assert [got["a", i] for i in range(1, 6)] == [("accepted", 2), ("conflict", 2), ("accepted", 3), ("accepted", 4), ("accepted", 5)]
    assert got["b", 1] == ("conflict", 5) and all(got["c", i] == ("unknown", None) for i in (1, 2, 3))
    made = folds.ordered_changes(old, changes, "k", [F.col("at").asc()], create=True)
    assert {(r.at, r.outcome, r.new_version) for r in made.where("k = 'c'").collect()} == {(1, "accepted", 1), (2, "accepted", 2), (3, "conflict", 2)}
    after = folds.after_changes(old.withColumn("v", F.lit("old")), made.withColumn("v", F.when(F.col("at") < 4, F.concat("k", "at"))), "k", F.col("at"), ["v"])
    assert rows(after) == [("a", 5, "a3"), ("b", 5, "old"), ("c", 2, "c2")]


def test_a_key_of_many_changes(spark):
    old = spark.createDataFrame([(1, 0)], "k int, version long")
    changes = spark.range(60_000).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 2 == 0, F.col("id") / 2).cast("long").alias("expected"))
    got = folds.ordered_changes(old, changes.repartition(7), "k", [F.col("id").asc()]).groupBy("outcome").agg(F.count("*"), F.max("new_version")).collect()
    version, accepted = 0, 0
    for i in range(60_000):
        if i % 2 or not i // 2 or i // 2 == version:
            version, accepted = version + 1, accepted + 1
    assert {r[0]: (r[1], r[2]) for r in got}["accepted"] == (accepted, version)


@pytest.fixture
def broadcast_at_run_time(spark):
    """Joins are planned as merges of shuffled rows, and broadcast once a side is seen to be small."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def many_changes(spark):
    """Five keys of 4,000 changes each, in seven files' worth of partitions; two of the keys are in the table."""
    old = spark.range(2).select(F.col("id").alias("k"), F.lit(1).alias("version"), F.lit(None).cast("long").alias("value")).repartition(2)
    changes = spark.range(20_000).select((F.col("id") % 5).alias("k"), "id", F.col("id").alias("value"), F.when(F.col("id") % 3 > 0, 1 + F.col("id") % 5).alias("expected"))
    want, accepted = {0: 1, 1: 1}, {0: 0, 1: 0}
    last = dict(want)
    for i in range(20_000):
        k, expected = i % 5, 1 + i % 5 if i % 3 else None
        if k in want and (not expected or expected == want[k]):
            want[k], accepted[k], last[k] = want[k] + 1, accepted[k] + 1, i
    return old, changes.repartition(7), want, accepted, last


def test_a_key_stays_together_when_a_join_turns_to_a_broadcast(spark, broadcast_at_run_time):
    old, changes, want, accepted, _ = many_changes(spark)
    judged = folds.ordered_changes(old, changes, "k", [F.col("id").asc()])
    got = judged.groupBy("k").agg(F.max("new_version").alias("v"), F.count_if(F.col("outcome") == "accepted").alias("n")).collect()
    assert {r.k: (r.v, r.n) for r in got} == {k: (want[k], accepted[k]) if k in want else (None, 0) for k in range(5)}


def test_the_table_after_changes_of_keys_that_stay_together(spark, broadcast_at_run_time):
    old, changes, want, _, last = many_changes(spark)
    judged = folds.ordered_changes(old, changes, "k", [F.col("id").asc()])
    after = folds.after_changes(old, judged, "k", F.col("id"), ["value"]).select("k", "version", "value")
    assert rows(after) == [(k, want[k], last[k]) for k in (0, 1)]


def plain_windows(times, width):
    out, begin = {}, None
    for t in sorted(times):
        if begin is None or t >= begin + width:
            begin = t
        out[begin] = out.get(begin, 0) + 1
    return out


def test_windows_in_batch_and_stream(spark, tmp_path):
    """A stream in several batches, out of order within the watermark, gives the windows of the batch."""
    rng = random.Random(1)
    events = [(f"u{rng.randrange(5)}", rng.randrange(0, 7200), i) for i in range(400)]
    table = spark.createDataFrame(events, "u string, s long, i int").withColumn("at", F.timestamp_seconds("s"))
    batch = folds.first_event_windows(table, "u", "at", 900, 3, "i")
    want = {}
    for u in {e[0] for e in events}:
        want |= {(u, t): n for t, n in plain_windows([e[1] for e in events if e[0] == u], 900).items()}
    got = {(r.u, r.t): (r.n, r.m) for r in batch.groupBy("u", F.unix_seconds("window_start").alias("t")).agg(F.count("*").alias("n"), F.count_if("allowed").alias("m")).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(m == min(n, 3) for n, m in got.values())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        path, out = str(tmp_path / "in"), str(tmp_path / "out")
        order = sorted(events, key=lambda e: e[1] + rng.uniform(-300, 300))
        for at in range(0, len(order), 100):  # each a batch; the last event of all closes every window
            part = order[at : at + 100] + ([("end", 40_000, 0)] if at + 100 >= len(order) else [])
            spark.createDataFrame(part, "u string, s long, i int").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
        found = windows.first_event_windows(stream, "u", "at", 900, "20 minutes")
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        streamed = {(r.key, r.t): r.number for r in spark.read.parquet(out).select("key", F.unix_seconds("window_start").alias("t"), "number").collect()}
        assert streamed == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_deletes(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    b = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, a long")
    c = spark.createDataFrame([(100, 10), (101, 11)], "id long, b long")
    d = spark.createDataFrame([(1000, 100, 1), (1001, None, 2)], "id long, c long, a long")
    relations = {"d": (d, "id"), "c": (c, "id"), "b": (b, "id"), "a": (a, "id")}
    refer = [deletes.Reference("b", "a", "a", deletes.CASCADE), deletes.Reference("c", "b", "b", deletes.CASCADE), deletes.Reference("d", "c", "c"), deletes.Reference("d", "a", "a", deletes.SET_NULL)]
    gone = {"a": a.where("id <> 4").union(spark.createDataFrame([(9,)], "id long"))}
    got = rows(deletes.deleted(relations, refer, gone))
    want = [("a", "1", "refused", None), ("a", "2", "removed", None), ("a", "3", "removed", None), ("a", "9", "unknown", None), ("b", "11", "removed", None), ("c", "101", "removed", None), ("d", "1001", "nulled", "a")]
    assert got == sorted(want, key=str)
    assert rows(deletes.deleted(relations, refer, {"a": a.limit(0)})) == []
    with pytest.raises(ValueError, match="cycle"):
        deletes.parents_first(["x", "y"], [deletes.Reference("x", "y", "y", deletes.CASCADE), deletes.Reference("y", "x", "x", deletes.CASCADE)])


def test_containment_has_no_nested_loop(spark):
    words = ["acetaminophen", "aminophylline", "amin", "min", "mi", "m", "", None, "phenytoin", "acetaminophen plus"]
    table = spark.createDataFrame(list(enumerate(words)), "i int, n string")
    asks = ["amin", "min", "m", "phen", "inop", "zzz", "acetaminophen plus codeine", "acetaminophen", "xyzmin"]
    df = spark.createDataFrame([(x,) for x in asks], "_ask string")
    found = containment.containing(df, table, ["n"], [F.col("i").asc()], 3, ["i"])
    want = sorted((a, i) for a in asks for i in [i for i, w in enumerate(words) if w and a in w][:3])
    assert rows(found.select("_ask", "i")) == sorted(want, key=str)
    lookup = joins.tiered_lookup(df.withColumnRenamed("_ask", "name").withColumn("k", F.monotonically_increasing_id()), table.where("n is not null"), "k", [("name", "n")], [("name", "n")], [F.col("i").asc()])
    for plan in (found, lookup):
        text = plan._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert {(r.name, r.i, r.tier) for r in lookup.where("name in ('min', 'phen', 'zzz')").collect()} == {("min", 3, 1), ("phen", 0, 2), ("zzz", None, None)}


def test_many_searches_are_single_ones(spark):
    rng = random.Random(3)
    names = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(2)) for _ in range(120)]
    table = spark.createDataFrame([(i, n, n[::-1]) for i, n in enumerate(names)], "i int, n string, m string")
    asks = sorted({"", "a", "zz", "c", "ab", " a", "b a", "abc", "cba c", *(n[rng.randrange(4) :][: rng.randrange(1, 6)] for n in names[:12])})
    got = search.many(spark.createDataFrame([(x,) for x in [*asks, None, asks[1]]], "query string"), table, ["n", "m"], ["i"], 4)
    found = {}
    for r in got.collect():
        found.setdefault(r.query, {})[r["rank"]] = r.i
    for x in asks:
        one = [r.i for r in search.prefix_first(table, ["n", "m"], x, ["i"], 4).collect()]
        assert [found.get(x, {})[k] for k in sorted(found.get(x, {}))] == one, x
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="characters"):
        search.many(spark.createDataFrame([("x" * 200,)], "query string"), table, ["n"], ["i"], 4)


def test_each_of_the_five_searches_of_many(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    terms = spark.createDataFrame([(i, word(), word()) for i in range(80)], "id int, brand string, generic string")
    known = spark.createDataFrame([(i, word() + " x") for i in range(80)], "id int, indication string")
    ill = spark.createDataFrame([(i, rng.choice(["", None, "I1", "I2"]), word(), word(), rng.choice(["", "c " + word()])) for i in range(80)], "id int, identity string, disease string, concept string, snomed string")
    asks = ["a", "bc", "ca", "cab", " x", "b x", "c ", "zz", "aaaa", ""]
    queries = spark.createDataFrame([(x,) for x in asks], "query string")
    for all_of, one_of, table in (("many_medications", "medications", terms), ("many_brands", "brands", terms), ("many_generics", "generics", terms), ("many_indications", "indications", known), ("many_conditions", "conditions", ill)):
        found = {}
        for r in getattr(search, all_of)(queries, table, 5).collect():
            found.setdefault(r.query, []).append((r["rank"], r.id))
        for x in asks:
            one = [r.id for r in getattr(search, one_of)(table, x, 5).collect()]
            have = [i for _, i in sorted(found.get(x, []))]
            assert (sorted(have) == sorted(one)) if one_of == "generics" else (have == one), (all_of, x)


def test_numbers_of_a_large_owner(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "big").when(F.col("id") % 20 == 0, "small").alias("owner"), (5000 - F.col("id")).alias("at"))
    got = dedup.sequence(df, ["owner"], [F.col("at").asc()], given=spark.createDataFrame([("big", 7)], "owner string, last long"))
    for owner, offset in (("big", 7), ("small", 0), (None, 0)):
        held = [(r.at, r.number) for r in got.where(F.col("owner").eqNullSafe(F.lit(owner))).orderBy("at").collect()]
        assert [n for _, n in held] == list(range(offset + 1, offset + 1 + len(held))) and held
    assert dedup.sequence(df.limit(0), ["owner"], [F.col("at").asc()]).count() == 0


def test_loads_are_counted_as_they_are_written(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "k string, v int")
    after, counts = merge.loaded(old, new, ["k"], [F.col("v").asc()], "r")
    assert rows(after) == [("a", 1), ("b", 2), ("c", 3)] and rows(counts) == [("r", 3, 1)]
    after, counts = merge.loaded(old, new, ["k"], [F.col("v").asc()], "r", replace=True)
    assert rows(after) == [("a", 1), ("b", 9), ("c", 3)] and rows(counts) == [("r", 3, 3)]
    after, counts = merge.loaded(old, new.limit(0), ["k"], [F.col("v").asc()], "r")
    assert rows(after) == rows(old) and rows(counts) == [("r", 0, 0)]


def test_import_needs_two_files(spark, tmp_path):
    old = {name: spark.createDataFrame([], schema) for name, (_, schema, _, _) in knowledge.RELATIONS.items()}
    with pytest.raises(FileNotFoundError):
        knowledge.import_all(spark, f"file://{tmp_path}", old, "DrugCentral")


def test_purge_is_of_one_source(spark):
    df = spark.createDataFrame([("\\N", "s"), ("\\N", "t"), (None, "s"), ("x", None)], "v string, source string")
    assert rows(knowledge.purged(df, "v", source="s")) == [("\\N", "t"), ("x", None), (None, "s")]


def test_a_dump_is_parsed_once(spark, tmp_path):
    with gzip.open(tmp_path / "a.sql.gz", "wt") as f:
        f.write("COPY public.t (a) FROM stdin;\n1\tx\n\\.\nCOPY public.u (a) FROM stdin;\n2\ty\n\\.\n")
    parsed = files.parsed_dump(spark, f"file://{tmp_path}")
    both = files.picked(parsed, "t", {"a": 0}).union(files.picked(parsed, "u", {"a": 0}))
    assert sorted(r.a for r in both.collect()) == ["1", "2"]
    plan = both._jdf.queryExecution().toString()
    assert "sql.gz" not in plan and "PartitionFilters: [isnotnull(table" in plan  # each reads its own table's folder


def test_digits_of_a_files_own_name(spark, tmp_path):
    for name in ("12345678/knowledge_20240131.csv", "12345678/plain-480900441.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r.path.rpartition("/")[2]: r.named for r in files.version(spark, f"file://{tmp_path}/12345678").collect()}
    assert got == {"knowledge_20240131.csv": "20240131", "plain-480900441.csv": None}


def test_variants_keep_their_shape(spark):
    texts = ['{"b": {"c": [1, {"d": null}]}, "a": 1.5, "x": "é"}', "[1, 2]", '"t"', "null", "{bad", None, "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", documents.parsed("t").alias("v"))
    got = {r.i: (r.s, r.d, r.n) for r in df.select("i", documents.written(documents.without("v", "a", "none")).alias("s"), documents.at("v", "$.b.c[0]", "int").alias("d"), documents.is_object("v").alias("n")).collect()}
    assert got[0] == ('{"b":{"c":[1,{"d":null}]},"x":"é"}', 1, True)
    assert [got[i][0] for i in range(1, 7)] == ["[1,2]", '"t"', "null", None, None, "{}"] and got[6][2]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    stamp = lambda s: F.timestamp_seconds(F.lit(s))
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, tie int, v string").select("k", stamp(100).alias("at"), "tie", "v")
    inbox, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    one.write.parquet(inbox)
    start = lambda c: tables.upsert_stream(spark.readStream.schema(one.schema).parquet(inbox), table, c, ["k"], "at", "tie", "1 hour").awaitTermination(120)
    start(state)
    want = [("a", "y"), ("b", "z")]
    last = lambda: rows(tables.latest(spark, table, one.schema, ["k"], "at", "tie").select("k", "v"))
    assert last() == want
    one.write.mode("append").parquet(inbox)  # the same changes, sent again
    start(state)
    assert last() == want
    start(str(tmp_path / "lost"))  # the state is lost: every batch runs again under its number
    assert last() == want
    tables.compacted(spark, table, one.schema, ["k"], "at", "tie", str(tmp_path / "small"))
    assert rows(tables.latest(spark, str(tmp_path / "small"), one.schema, ["k"], "at", "tie").select("k", "v")) == want


def test_append_log(spark, tmp_path):
    df = spark.range(10)
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        rates.append_log(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(120)
    rates.append_log(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 20
