import gzip

from evidara.plans import knowledge, ranking, reports, safety
from evidara.sources import files
from evidara.streaming.rates import rates
from pyspark.sql import functions as F

DISEASE = "id string, drug string, identity string, disease string, concept string, snomed string, cui string, imported_at timestamp, assessment string"
SOURCE = safety.DISEASES_SOURCE


def known(spark):
    row = ("1", "ibuprofen", "UMLS:C1234567", "chronic kidney disease", "renal insufficiency", "chronic kidney disease", "C1234567", None, "HIGH")
    return spark.createDataFrame([row, ("2", "x", "UMLS:C0000001", "pain", "pain", "", "C0000001", None, "LOW"), ("3", "x", "UMLS:C0000002", "pain", "", "", "C0000002", None, "LOW")], DISEASE).withColumn("source", F.lit(SOURCE))


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "a string, b string, severity string, imported_at timestamp, id string").withColumn("source", F.lit(safety.PAIRS_SOURCE))


def tables(spark, generic="Warfarin", display="Chronic kidney disease", code=None, proposed="Ibuprofen"):
    c = spark.createDataFrame([("c", proposed, "Pain")], "consultation string, proposed string, indication string")
    m = spark.createDataFrame([("c", "m1", generic, "ACTIVE"), ("c", "m2", generic, "ON_HOLD")], "consultation string, medicine string, generic string, status string")
    k = spark.createDataFrame([("k", "c", display, code)], "condition string, consultation string, display string, code string")
    return c, m, k


def test_resolutions(spark):
    rows = [("a", "Chronic kidney disease", None), ("b", "Renal insufficiency", None), ("c", "local", "UMLS:C1234567"), ("d", "unrelated", None), ("e", "Pain", None)]
    got = safety.resolutions(spark.createDataFrame(rows, "condition string, display string, code string"), known(spark)).collect()
    assert {r.condition: (r.resolution, r.match_type) for r in got} == {
        "a": ("RESOLVED", "CANONICAL_TERM"), "b": ("RESOLVED", "CONCEPT_SOURCE_ALIAS"), "c": ("RESOLVED", "UMLS_IDENTIFIER"), "d": ("UNRESOLVED", None), "e": ("AMBIGUOUS", None),
    }


def test_assessment(spark):
    c, m, k = tables(spark)
    got = safety.assess(c, m, k, pairs(spark, ("ibuprofen", "warfarin", "MAJOR", None, "1"), ("ibuprofen", "warfarin", "MINOR", None, "2")), known(spark)).head()
    assert (got.severity, got.assessment, got.overall, got.n_interactions, got.data_status) == ("MAJOR", "HIGH", "HIGH", 1, "DATASET_MATCHED")
    c, m, k = tables(spark, "Nothing", "unrelated")
    assert safety.assess(c, m, k, pairs(spark), known(spark)).head().overall == "NOT_EVALUATED"


def test_synonyms_are_for_pairs_only(spark):
    c, m, _ = tables(spark, proposed="Paracetamol + Tramadol")
    met = safety.interactions(c, m, pairs(spark, ("acetaminophen", "warfarin", "MODERATE", None, "1"))).collect()
    assert [r.severity for r in met] == ["MODERATE"]


def test_ranking_leaves_the_proposal_out(spark):
    c, m, k = tables(spark)
    ind = spark.createDataFrame([("pain", "Paracetamol", "paracetamol"), ("pain", "Ibuprofen", "ibuprofen")], "indication string, drug string, normalised string").withColumn("source", F.lit(SOURCE))
    got = ranking.ranked(c, m, k, ind, pairs(spark), known(spark)).collect()
    assert [(r.drug, r.rank) for r in got] == [("Paracetamol", 1)]


def test_cut_comes_before_rank(spark):
    c, m, k = tables(spark)
    ind = spark.createDataFrame([("pain", f"d{i:02}", f"d{i:02}") for i in range(30)], "indication string, drug string, normalised string").withColumn("source", F.lit(SOURCE))
    assert ranking.candidates(c, ind).count() == 25


def test_interactions_of_files(spark):
    raw = spark.createDataFrame([("B", "A", " major ", "f", 1), ("A", "B", "MAJOR", "f", 2), ("A", "B", "Minor", "f", 3), ("A", None, "MAJOR", "f", 4), ("A", "C", "Unknown", "f", 5)], "drug_a string, drug_b string, level string, file string, line int")
    clean = knowledge.interactions(raw, "s", "v")
    assert sorted((r.a, r.b, r.severity, r.line) for r in clean.collect()) == [("a", "b", "MAJOR", 1), ("a", "b", "MINOR", 3)]
    assert [r.severity for r in knowledge.loaded_interactions(clean).collect()] == ["MAJOR"]


def test_dump_relationships(spark, tmp_path):
    names = "\n".join("\t".join([i, *["x"] * 8, n]) for i, n in (("1", "Old"), ("1", "Ibuprofen"), ("2", "Other")))
    rel = "\n".join("\t".join(["9", s, "x", r, c, u, n]) for s, r, c, u, n in (("1", "contraindication", "Kidney", "C1234567", "\\N"), ("1", "off-label use", "Pain", "\\N", "\\N"), ("7", "indication", "Pain", "", "")))
    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write(f"COPY public.structures (id) FROM stdin;\n{names}\n\\.\nCOPY public.omop_relationship (id) FROM stdin;\n{rel}\n\\.\n")
    rows = knowledge.relationships(files.dump_sections(spark, str(tmp_path)), "v1")
    assert [(r.drug, r.identity, r.assessment) for r in knowledge.diseases(rows).collect()] == [("ibuprofen", "UMLS:C1234567", "HIGH")]
    assert [r.drug for r in knowledge.indications(rows).collect()] == ["Ibuprofen"] and knowledge.indications(rows, strict=True).count() == 0


def test_status_is_compared_after_the_cut(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    children = spark.createDataFrame([(1, 1, "P"), (2, 1, "F"), (3, 1, "P")], "k int, at int, status string").withColumn("tie", F.col("k"))
    assert [r.k for r in reports.parent_list(parents, children, "k", [F.col("k").asc()], 2, "at", "tie", "P").collect()] == [1]


def test_rates_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:0%d:00" % i, 1) for i in range(5)], "ts string, u int").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "u", "ts", "15 minutes", 3, "1 hour")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("rates").select("u", "n").collect()] == [tuple(r) for r in rates(rows, "u", "ts", "15 minutes", 3).select("u", "n").collect()] == [(1, 5)]


def test_explanations_fall_back(spark):
    more = "a string, b string, severity string, imported_at timestamp, id string, drug_a string, drug_b string, raw_severity string, source string"
    pair = spark.createDataFrame([("ibuprofen", "warfarin", "MAJOR", None, "1", "Ibuprofen", "Warfarin", "Major", safety.PAIRS_SOURCE)], more)
    ill = known(spark).withColumns({"shown": F.col("disease"), "relationship": F.lit("contraindication"), "version": F.lit("v")})
    texts = lambda *a: sorted(r.explanation for r in safety.explanations(*a, pair, ill).collect())
    assert texts(*tables(spark))[1].startswith("Ibuprofen + Warfarin: Major (DDInter 2.0).")
    assert "No DDInter 2.0 record for ibuprofen + nothing." in texts(*tables(spark, "Nothing", "unrelated"))
    assert any("could not be deterministically resolved" in x for x in texts(*tables(spark, "Nothing", "unrelated")))
    c, m, k = tables(spark)
    assert texts(c, m.limit(0), k.limit(0)) == sorted([safety.NO_MEDICINES, safety.NO_CONDITIONS])


def test_names_are_ranked_as_in_a_dictionary(spark):
    c, m, k = tables(spark, "Nothing", "unrelated")
    ind = spark.createDataFrame([("pain", x, x.lower()) for x in ("Zinc", "amoxicillin", "Éclair", "dapsone")], "indication string, drug string, normalised string").withColumn("source", F.lit(SOURCE))
    got = ranking.ranked(c, m, k, ind, pairs(spark), known(spark)).orderBy("rank").collect()
    assert [r.drug for r in got] == ["amoxicillin", "dapsone", "Éclair"]


def test_lookup_sends_a_row_for_each_text(spark):
    from evidara.operators import joins

    rows = spark.range(1000).select("id", F.lit("x").alias("name"))
    terms = spark.range(500).select(F.col("id").alias("term"), F.lit("x").alias("brand"))
    found = joins.tiered_lookup(rows, terms, "id", [("name", "brand")], [("name", "brand")], [F.col("term").asc()])
    assert found.count() == 1000 and found.select("term", "tier").distinct().collect() == [(0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > 0  # distinct texts are looked up


def test_trims_take_any_white_space(spark):
    from evidara.functions import text, validation

    row = spark.range(1).select(text.concept_code(F.lit("\t umls:C1234567 \n")).alias("c"), text.local_code(F.lit("\n DRUGCENTRAL:x\t")).alias("l"), validation.filled(F.lit("\t\n"), 5).alias("f")).head()
    assert (row.c, row.l, row.f) == ("C1234567", "DRUGCENTRAL:x", False)


def test_required_sources(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        files.required(spark, f"file://{tmp_path}/none")


def test_knowledge_without_an_identity_says_nothing(spark):
    """Newer rows without an identity, and another source's, leave a condition as it was resolved."""
    newer = known(spark).where("id = '1'").withColumns({"id": F.lit("9"), "imported_at": F.lit("2030-01-01").cast("timestamp")})
    rows = known(spark).unionByName(newer.withColumn("identity", F.lit(None).cast("string"))).unionByName(newer.withColumn("identity", F.lit(""))).unionByName(newer.withColumns({"identity": F.lit("OTHER:1"), "source": F.lit("Other")}))
    conditions = spark.createDataFrame([("a", "Chronic kidney disease", None), ("b", "local", "DRUGCENTRAL:x")], "condition string, display string, code string")
    local = newer.withColumns({"identity": F.lit("DRUGCENTRAL:x"), "disease": F.lit("other"), "concept": F.lit(""), "snomed": F.lit(""), "cui": F.lit(None).cast("string")})
    got = {r.condition: (r.resolution, r.identity, r.match_type) for r in safety.resolutions(conditions, rows.unionByName(local)).collect()}
    assert got == {"a": ("RESOLVED", "UMLS:C1234567", "CANONICAL_TERM"), "b": ("RESOLVED", "DRUGCENTRAL:x", "DRUGCENTRAL_IDENTIFIER")}
    c, m, k = tables(spark)
    assert safety.assess(c, m, k, pairs(spark), rows).head().assessment == "HIGH"


def test_other_sources_take_no_part(spark):
    c, m, k = tables(spark)
    other = pairs(spark, ("ibuprofen", "warfarin", "MAJOR", None, "2")).withColumn("source", F.lit("Other"))
    both = pairs(spark, ("ibuprofen", "warfarin", "MINOR", None, "1")).unionByName(other)
    assert [r.severity for r in safety.interactions(c, m, both).collect()] == ["MINOR"]
    assert [r.severity for r in safety.interactions(c, m, both, source=None).collect()] == ["MAJOR"]


def test_input_hash_is_of_all_that_a_ranking_rests_on(spark):
    full = known(spark).withColumns({"shown": F.col("disease"), "snomed_shown": F.col("snomed"), "generic": F.col("drug"), "relationship": F.lit("r"), "evidence": F.lit("e"), "version": F.lit("v")})
    pair = pairs(spark, ("ibuprofen", "warfarin", "MAJOR", None, "1")).withColumns({"drug_a": F.lit("I"), "drug_b": F.lit("W"), "raw_severity": F.lit("Major"), "version": F.lit("v"), "id_a": F.lit("1"), "id_b": F.lit("2")})

    def hashed(pair=pair, full=full, engine=ranking.ENGINE, **more):
        return ranking.input_hash(*tables(spark, **more), pair, full, engine).head().input_hash

    base = hashed()
    assert base == hashed()
    others = [hashed(display="Pain"), hashed(generic="Nothing"), hashed(proposed="Aspirin"), hashed(engine="x"), hashed(pair=pair.withColumn("severity", F.lit("MINOR"))), hashed(pair=pair.withColumn("version", F.lit("w"))), hashed(full=full.withColumn("evidence", F.lit("other")))]
    assert base not in others and len(set(others)) == len(others)


def test_evidence_is_looked_up_once_for_each_two_names(spark):
    """A hundred consultations of the same two names meet one row of evidence."""
    c = spark.range(100).select("id", F.col("id").alias("consultation"), F.lit("Ibuprofen").alias("proposed"))
    m = c.select("consultation", F.lit("Warfarin + Ibuprofen").alias("generic"))
    best = safety.pair_evidence(c, m, pairs(spark, ("ibuprofen", "warfarin", "MAJOR", None, "1"), ("ibuprofen", "ibuprofen", "MAJOR", None, "2")))
    assert [(r.proposed, r.generic, r.a, r.b) for r in best.collect()] == [("Ibuprofen", "Warfarin + Ibuprofen", "ibuprofen", "warfarin")]


def test_findings_of_alternatives(spark, monkeypatch):
    """Each medicine and each row of knowledge is a finding, whether knowledge is sent or dealt; a lower level ranks first, then names."""
    from evidara.sources import files

    c, m, k = tables(spark)
    c = c.union(spark.createDataFrame([("d", "Paracetamol", "Pain"), ("e", None, "Pain"), ("f", "Ibuprofen", "None")], c.schema))
    m = m.union(spark.createDataFrame([("c", "m3", "Warfarin", "ACTIVE"), ("c", "m4", None, "ACTIVE"), ("x", "m5", "Warfarin", "ACTIVE")], m.schema))
    ind = spark.createDataFrame([("pain", x, x.lower()) for x in ("Zinc", "Aspirin", "Ibuprofen", "Paracetamol")], "indication string, drug string, normalised string").withColumn("source", F.lit(SOURCE))
    pair = pairs(spark, ("aspirin", "warfarin", "MAJOR", None, "1"), ("warfarin", "zinc", "MINOR", None, "2"))
    ill = known(spark).where("id = '1'").withColumn("drug", F.explode(F.array(F.lit("zinc"), F.lit("paracetamol"))))
    ill = ill.unionByName(ill.withColumns({"id": F.lit("7"), "assessment": F.lit("LOW")}).where("drug = 'zinc'"))
    for most in (50_000, 0):
        monkeypatch.setattr(files, "MOST_SENT", most)
        rows = ranking.explained(c, m, k, ind, pair, ill).select("consultation", "rank", "drug", "severity", "disease_assessment", "assessment", "n_interactions", "n_diseases")
        assert sorted(map(tuple, rows.collect())) == [
            ("c", 1, "Aspirin", "MAJOR", "NOT_EVALUATED", "HIGH", 2, 0), ("c", 2, "Paracetamol", "NOT_EVALUATED", "HIGH", "HIGH", 0, 1), ("c", 3, "Zinc", "MINOR", "HIGH", "HIGH", 2, 2),
            ("d", 1, "Aspirin", "NOT_EVALUATED", "NOT_EVALUATED", "NOT_EVALUATED", 0, 0), ("d", 2, "Ibuprofen", "NOT_EVALUATED", "NOT_EVALUATED", "NOT_EVALUATED", 0, 0), ("d", 3, "Zinc", "NOT_EVALUATED", "NOT_EVALUATED", "NOT_EVALUATED", 0, 0),
        ]
        found = ranking.findings(c, m, k, ind, pair, ill).select("consultation", "rank", "kind", "subject", "level")
        assert sorted(map(tuple, found.collect())) == [
            ("c", 1, "interaction", "m1", "MAJOR"), ("c", 1, "interaction", "m3", "MAJOR"), ("c", 2, "disease", "k", "HIGH"), ("c", 3, "disease", "k", "HIGH"), ("c", 3, "disease", "k", "LOW"),
            ("c", 3, "interaction", "m1", "MINOR"), ("c", 3, "interaction", "m3", "MINOR"),
        ]
