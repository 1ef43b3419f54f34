"""Findings and explanations, record details, the five searches, loads of knowledge, and changes to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.bindings.basics import QUERIES, query, t
from evidara.bindings.changes import source_files
from evidara.bindings.composed import DDI, DISEASES, ORDERS, case, disease_knowledge, indications, pair_knowledge
from evidara.functions import text, validation
from evidara.operators import dedup, joins, merge, search
from evidara.plans import details, knowledge, ranking, risk, safety
from evidara.sources import files

_ = QUERIES

CASES = f"""{DDI}, {ORDERS}, {DISEASES},
i AS (SELECT p.l_orderkey AS k, m.p_brand AS med, p.brand AS own, a, b, sev FROM proposed p JOIN meds m ON m.l_orderkey = p.l_orderkey AND m.p_brand <> p.brand JOIN ddi ON a = least(p.brand, m.p_brand) AND b = greatest(p.brand, m.p_brand)),
f AS (SELECT o_orderkey AS k, resolved.term, resolved.identity, sev FROM orders JOIN customer ON o_custkey = c_custkey JOIN proposed p ON p.l_orderkey = o_orderkey JOIN resolved ON term = c_mktsegment JOIN dd ON dd.brand = p.brand AND dd.identity = resolved.identity)"""
_S, _A = "(['NOT_EVALUATED', 'MINOR', 'MODERATE', 'MAJOR'])", "(['NOT_EVALUATED', 'LOW', 'MODERATE', 'HIGH'])"


@query(f"""WITH {CASES}
SELECT k AS consultation, 'interaction' AS kind, k || '/' || med AS subject, lower(replace(a, '#', ' ')) || ' + ' || lower(replace(b, '#', ' ')) AS detail, {_S}[sev + 1] AS level FROM i
UNION ALL SELECT k, 'disease', k::VARCHAR, identity, {_A}[sev + 1] FROM f""")
def assessment_findings(s, d):
    return safety.findings(**case(s, d), pair_knowledge=pair_knowledge(s, d), disease_knowledge=disease_knowledge(s, d))


@query(f"""WITH {CASES}, n AS (SELECT o_orderkey AS k, p.brand AS own, c_mktsegment AS term FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN proposed p ON p.l_orderkey = o_orderkey)
SELECT k AS consultation, 'drugs' AS part, k || '/' || med AS subject, a || ' + ' || b || ': ' || (['Minor', 'Moderate', 'Major'])[sev] || ' (DDInter 2.0).' AS explanation FROM i
UNION ALL SELECT k, 'drugs', k || '/' || p_brand, 'No DDInter 2.0 record for ' || coalesce(lower(replace(own, '#', ' ')), '') || ' + ' || lower(replace(p_brand, '#', ' ')) || '.' FROM n JOIN meds ON l_orderkey = k WHERE k NOT IN (SELECT k FROM i)
UNION ALL SELECT k, 'drugs', NULL, 'No active medicines were available for a DDInter 2.0 check.' FROM n WHERE k NOT IN (SELECT l_orderkey FROM meds)
UNION ALL SELECT k, 'diseases', k::VARCHAR, 'Entered condition: ' || term || ' → resolved DrugCentral term: ' || term || ' (' || identity || ') → DrugCentral relationship: rel ' || lower({_A}[sev + 1]) || ' → assessment: ' || {_A}[sev + 1] || '. Source: DrugCentral v1.' FROM f
UNION ALL SELECT k, 'diseases', k::VARCHAR, 'Entered condition: ' || n.term || CASE WHEN r.term IS NULL THEN ' could not be deterministically resolved to a DrugCentral disease identity; no relationship was claimed.'
  ELSE ' → resolved DrugCentral term: ' || r.term || ' (' || r.identity || '), but no DrugCentral relationship was found for the proposed drug.' END FROM n LEFT JOIN resolved r USING (term) WHERE k NOT IN (SELECT k FROM f)""")
def assessment_explanations(s, d):
    return safety.explanations(**case(s, d), pair_knowledge=pair_knowledge(s, d), disease_knowledge=disease_knowledge(s, d))


@query(f"""WITH {CASES} SELECT k AS consultation, k || '/' || med AS medicine, own AS proposed, med AS generic, {_S}[sev + 1] AS severity, a AS drug_a, b AS drug_b, (['Minor', 'Moderate', 'Major'])[sev] AS raw_severity, 'DDInter 2.0' AS source, 'v1' AS version,
'D' || substr(a, 7) AS id_a, 'D' || substr(b, 7) AS id_b, lower(replace(own, '#', ' ')) AS matched_proposed, lower(replace(med, '#', ' ')) AS matched_existing FROM i""")
def interaction_evidence(s, d):
    """Whole interaction findings, with the evidence as its source has it."""
    c = case(s, d)
    out = safety.pair_findings(c["consultations"], c["medicines"], pair_knowledge(s, d))
    return out.withColumns({k: F.array_join(k, ",") for k in ("matched_proposed", "matched_existing")})


@query(f"""WITH {CASES} SELECT k AS consultation, k AS condition, term AS entered, NULL::VARCHAR AS code, 'CANONICAL_TERM' AS match_type, term AS resolved, identity, p.brand AS proposed, {_A}[sev + 1] AS assessment, 'rel ' || lower({_A}[sev + 1]) AS relationship,
'rel | ' || term AS evidence, 'DrugCentral' AS source, 'v1' AS version, NULL::VARCHAR AS cui, NULL::VARCHAR AS snomed_shown, term AS shown, p.brand AS generic FROM f JOIN proposed p ON p.l_orderkey = k""")
def disease_evidence(s, d):
    """Whole disease findings, with how their condition was resolved."""
    c = case(s, d)
    out = safety.illness_findings(c["consultations"], c["conditions"], disease_knowledge(s, d))
    return out.select("consultation", "condition", "entered", "code", "match_type", "resolved", "identity", "proposed", *safety.DISEASE_DETAILS)


@query(f"""WITH {DDI}, {ORDERS}, t AS (SELECT o_orderkey, p.brand FROM orders LEFT JOIN proposed p ON p.l_orderkey = o_orderkey)
SELECT o_orderkey AS consultation, o_orderkey || '/' || p_brand AS medicine, brand AS proposed, p_brand AS generic, coalesce(lower(replace(brand, '#', ' ')), '') AS proposed_terms, lower(replace(p_brand, '#', ' ')) AS existing_terms FROM t JOIN meds ON l_orderkey = o_orderkey""")
def evaluated_pairs(s, d):
    """What an assessment has looked up, found or not."""
    c = case(s, d)
    return safety.evaluated_pairs(c["consultations"], c["medicines"]).withColumns({k: F.array_join(k, ",") for k in ("proposed_terms", "existing_terms")})


RANKED = f"""{DDI}, {ORDERS}, {DISEASES},
cap AS (SELECT DISTINCT o_orderpriority AS priority, brand FROM (SELECT DISTINCT o_orderpriority FROM orders) JOIN brands ON (n + substr(o_orderpriority, 1, 1)::INT) % 2 = 0),
c AS MATERIALIZED (SELECT o_orderkey, cap.brand, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN proposed p ON p.l_orderkey = o_orderkey JOIN cap ON priority = o_orderpriority WHERE cap.brand <> p.brand),
i AS MATERIALIZED (SELECT c.o_orderkey, c.brand, c.o_orderkey || '/' || m.p_brand AS subject, sev FROM c JOIN meds m ON m.l_orderkey = c.o_orderkey AND m.p_brand <> c.brand JOIN ddi ON a = least(c.brand, m.p_brand) AND b = greatest(c.brand, m.p_brand)),
f AS MATERIALIZED (SELECT c.o_orderkey, c.brand, c.o_orderkey::VARCHAR AS subject, sev FROM c JOIN resolved ON term = c_mktsegment JOIN dd ON dd.brand = c.brand AND dd.identity = resolved.identity),
i1 AS (SELECT o_orderkey, brand, max(sev) AS s, count(*) AS n FROM i GROUP BY ALL), f1 AS (SELECT o_orderkey, brand, max(sev) AS s, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT c.o_orderkey, c.brand, coalesce(i1.s, 0) AS s, coalesce(f1.s, 0) AS a, coalesce(i1.n, 0) AS ni, coalesce(f1.n, 0) AS nf, greatest(coalesce(i1.s, 0), coalesce(f1.s, 0)) AS o FROM c LEFT JOIN i1 USING (o_orderkey, brand) LEFT JOIN f1 USING (o_orderkey, brand)),
top AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY o_orderkey ORDER BY (CASE o WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE o END), brand))::INT AS rank FROM r QUALIFY rank <= 3)"""


@query(f"""WITH {RANKED} SELECT o_orderkey AS consultation, brand AS drug, rank, {_A}[o + 1] AS assessment, {_S}[s + 1] AS severity, {_A}[a + 1] AS disease_assessment, ni AS n_interactions, nf AS n_diseases,
CASE WHEN ni + nf > 0 THEN 'DATASET_MATCHED' ELSE 'NO_DATASET_MATCH' END AS data_status, 'indication' AS relationship, 'indication | ' || brand AS evidence,
'{" ".join(ranking.REASONS)}' AS reasons FROM top""")
def ranking_reasons(s, d):
    out = ranking.explained(**case(s, d), indications=indications(s, d), pair_knowledge=pair_knowledge(s, d), disease_knowledge=disease_knowledge(s, d))
    return out.select("consultation", "drug", "rank", "assessment", "severity", "disease_assessment", "n_interactions", "n_diseases", "data_status", "relationship", "evidence", F.array_join("reasons", " ").alias("reasons"))


@query(f"""WITH {RANKED} SELECT o_orderkey AS consultation, brand AS drug, 'interaction' AS kind, subject, {_S}[i.sev + 1] AS level, rank FROM i JOIN top USING (o_orderkey, brand)
UNION ALL SELECT o_orderkey, brand, 'disease', subject, {_A}[f.sev + 1], rank FROM f JOIN top USING (o_orderkey, brand)""")
def ranking_findings(s, d):
    return ranking.findings(**case(s, d), indications=indications(s, d), pair_knowledge=pair_knowledge(s, d), disease_knowledge=disease_knowledge(s, d))


_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'in-progress' WHEN 'F' THEN 'completed' ELSE 'cancelled' END"


@query(f"""SELECT c_custkey AS id, c_name AS name, coalesce(string_agg(o_orderkey || ':' || {_STATUS} || ':' || o_orderpriority, ',' ORDER BY o_orderdate DESC, o_orderkey DESC), '') AS consultations,
count(o_orderkey) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7 AND NOT c_acctbal < 0 GROUP BY ALL""")
def patient_detail(s, d):
    """A nested record of each of an owner's customers: orders, the newest first."""
    state = F.when(F.col("o_orderstatus") == "P", "IN_PROGRESS").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("CANCELLED")
    visits = t(s, d, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), state.alias("status"), F.col("o_orderpriority").alias("indication"))
    people = t(s, d, "customer").where((F.col("c_nationkey") == 7) & ~(F.col("c_acctbal") < 0)).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    out = details.patients(people, {"consultations": visits})
    held = F.array_join(F.transform("consultations", lambda x: F.concat_ws(":", x["id"], x["status"], x["indication"])), ",")
    return out.select("id", "name", held.alias("consultations"), F.size("consultations").cast("bigint").alias("n"), F.get("consultations", F.lit(0))["id"].alias("latest"))


@query(f"""SELECT o_orderkey AS id, {_STATUS} AS status, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS latest_note, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_shipdate DESC, l_linenumber DESC), '') AS follow_ups
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL""")
def consultation_detail(s, d):
    state = F.when(F.col("o_orderstatus") == "P", "IN_PROGRESS").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("CANCELLED")
    visits = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), state.alias("status"))
    lines = t(s, d, "lineitem").select(F.col("l_orderkey").alias("consultation"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("created_at")).distinct()
    out = details.consultations(visits, lines, lines)
    return out.select("id", "status", F.col("latest_note.id").alias("latest_note"), F.array_join(F.transform("follow_ups", lambda x: x["id"].cast("string")), ",").alias("follow_ups"))


def _ranked_sql(hit: str, fields: str, begins: str, tie: str, limit: int) -> str:
    return f"SELECT * FROM (SELECT * FROM v WHERE {hit} ORDER BY {fields}, {tie} LIMIT 400) ORDER BY (CASE WHEN {begins} THEN 0 ELSE 1 END), {fields}, {tie} LIMIT {limit}"


_TERMS = "WITH v AS (SELECT p_partkey AS id, p_name AS brand, lower(p_type) AS generic FROM part)"


def _drug_terms(s, d):
    return t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("brand"), F.lower("p_type").alias("generic"))


@query(_TERMS + " SELECT id, brand FROM (" + _ranked_sql("brand LIKE 'pro%' OR generic LIKE 'pro%'", "concat_ws(' ', brand, generic)", "brand LIKE 'pro%' OR generic LIKE 'pro%'", "id", 30) + ")")
def search_medications(s, d):
    return search.medications(_drug_terms(s, d), "pro").select("id", "brand")


@query(_TERMS + " SELECT id, brand FROM (" + _ranked_sql("contains(brand, 'gear')", "brand", "brand LIKE 'gear%'", "id", 50) + ")")
def search_brands(s, d):
    return search.brands(_drug_terms(s, d), "gear", 99).select("id", "brand")


@query(_TERMS + " SELECT generic, min(id) AS id FROM (" + _ranked_sql("contains(generic, 'o')", "generic", "generic LIKE 'o%'", "id", 30) + ") GROUP BY ALL")
def search_generics(s, d):
    return search.generics(_drug_terms(s, d), "o").select("generic", "id")


@query("WITH v AS (SELECT p_partkey AS id, p_name AS indication FROM part), f AS (" + _ranked_sql("indication LIKE 's%'", "indication", "indication LIKE 's%'", "id", 400) + ") SELECT indication, min(id) AS id FROM f GROUP BY ALL ORDER BY indication LIMIT 5")
def search_indications(s, d):
    return search.indications(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("indication")), "s", 5).select("indication", "id")


@query("""WITH v AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN '' ELSE 'N' || c_nationkey END AS identity, lower(c_mktsegment) AS disease, lower(c_name) AS concept, '' AS snomed FROM customer),
f AS (""" + _ranked_sql("disease LIKE 'ma%' OR concept LIKE 'ma%' OR snomed LIKE 'ma%'", "concat_ws(' ', disease, concept, snomed)", "TRUE", "id", 400) + """)
SELECT id, identity, disease FROM f QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(identity, ''), disease) ORDER BY concat_ws(' ', disease, concept, snomed), id) = 1 ORDER BY concat_ws(' ', disease, concept, snomed), id LIMIT 7""")
def search_conditions(s, d):
    own = F.when(F.col("c_nationkey") < 5, "").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    known = t(s, d, "customer").select(F.col("c_custkey").alias("id"), own.alias("identity"), F.lower("c_mktsegment").alias("disease"), F.lower("c_name").alias("concept"), F.lit("").alias("snomed"))
    return search.conditions(known, "ma", 7).select("id", "identity", "disease")


def _spelt(name: str) -> str:
    return f"CASE n_nationkey % 3 WHEN 0 THEN lower({name}) WHEN 1 THEN upper({name}) ELSE {name} END"


@query(f"SELECT n_nationkey, row_number() OVER (ORDER BY lower(x), x = upper(x), n_nationkey) AS place FROM (SELECT n_nationkey, {_spelt('n_name')} AS x FROM nation)")
def locale_order(s, d):
    """Places in the order of a dictionary; a table of a few dozen rows, in one window."""
    from pyspark.sql import Window

    rows = t(s, d, "nation").select("n_nationkey", F.expr(_spelt("n_name")).alias("x"))
    return rows.select("n_nationkey", F.row_number().over(Window.orderBy(*text.by_locale("x"), "n_nationkey")).cast("bigint").alias("place"))


_LEVEL = "CASE p_size % 4 WHEN 0 THEN ' major ' WHEN 1 THEN 'Minor' WHEN 2 THEN 'Moderate' ELSE 'Unknown' END"


@query(f"""WITH r AS (SELECT p_partkey AS k, p_name AS x, lower(p_type) AS y, upper(trim({_LEVEL})) AS level FROM part), c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM r WHERE level <> 'UNKNOWN' AND x <> ''),
one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY a, b, level ORDER BY k) = 1) SELECT a, b, arg_min(level, k) AS severity FROM one GROUP BY ALL""")
def csv_etl(s, d):
    """A folder of CSV files of interactions, read, cleaned, and loaded: of a pair's levels the first one counts, in the first of the files."""
    line = F.concat_ws(",", F.lit("X1"), F.concat(F.lit('"'), "p_name", F.lit('"')), F.lit("X2"), F.lower("p_type"), F.expr(_LEVEL))
    path = source_files(s, t(s, d, "part").select(F.col("p_partkey").alias("key"), line.alias("value")), ["id_a,drug_a,id_b,drug_b,level"])
    raw = files.csv(s, path, files.INTERACTIONS, "*")
    return knowledge.loaded_interactions(knowledge.interactions(raw, "pairs", "v1")).select("a", "b", "severity")


@query("""SELECT arg_min(p_name, p_partkey) AS brand, p_name AS normalised_brand, arg_min(p_type || ' + salt', p_partkey) AS generic, lower(p_type) || ' salt' AS normalised_generic FROM part GROUP BY p_name, p_type""")
def terminology_etl(s, d):
    line = F.concat_ws(",", F.concat("p_name", F.lit(" ")), F.concat(F.lit('"'), "p_type", F.lit(' (x, y)+salt"')))
    path = source_files(s, t(s, d, "part").select(F.col("p_partkey").alias("key"), line.alias("value")), ["brand,salt"])
    raw = files.csv(s, path, "brand string, salt string", "*")
    return knowledge.terminology(raw, "brand", "salt", "terms", "v1").select("brand", "normalised_brand", "generic", "normalised_generic")


@query("""SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part""")
def copy_dump_sections(s, d):
    r"""A dump with two sections, of which one is picked; \N is null."""
    row = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("\\N"))
    after = ["\\.", "", "COPY public.others (id) FROM stdin;", "7\tx", "\\."]
    path = source_files(s, t(s, d, "part").select(F.col("p_partkey").alias("key"), row.alias("value")), ["COPY public.parts (id, name, brand) FROM stdin;"], after)
    found = files.picked(files.dump_sections(s, path), "parts", {"id": 0, "name": 1, "brand": 2})
    return found.select(F.col("id").cast("bigint").alias("id"), "name", "brand")


@query("""SELECT 'terms' AS relation, count(*) AS processed, count(DISTINCT p_name) FILTER (p_name NOT IN (SELECT p_name FROM part WHERE p_size < 5)) AS inserted FROM part WHERE p_size >= 5
UNION ALL SELECT 'levels', count(*), count(*) FROM part WHERE p_size >= 5""")
def knowledge_load(s, d):
    """Counts of two loads, one that ignores keys it has, one that replaces their rows; the new rows pass through NDJSON."""
    part = t(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    path = files.new_path(s, "terms.ndjson")
    files.write_ndjson(part.where("p_size >= 5"), path)
    new = files.ndjson(s, files.required(s, path), "p_partkey long, p_name string, p_brand string, p_size int")
    order, old = [F.col("p_partkey").asc()], part.where("p_size < 5")
    _, terms = merge.loaded(dedup.first_wins(old, ["p_name"], order), new, ["p_name"], order, "terms")
    _, levels = merge.loaded(dedup.first_wins(old, ["p_brand"], order), new, ["p_brand"], order, "levels", replace=True)
    return terms.union(levels)


@query("SELECT p_partkey FROM part WHERE NOT (p_size % 5 = 0 OR p_partkey % 7 = 0)")
def purge_marked(s, d):
    rows = t(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "\\N").alias("x"), F.when(F.col("p_partkey") % 7 == 0, "\\N").otherwise("y").alias("y"))
    return knowledge.purged(rows, "x", "y").select("p_partkey")


@query("SELECT c_custkey, lower(c_name) AS q, CASE WHEN c_nationkey % 2 = 0 THEN 'DRUGCENTRAL:' || c_nationkey END AS code, c_nationkey % 3 > 0 AS named FROM customer")
def canonical_input(s, d):
    """Queries without outer and repeated white space of any kind, local codes, and the rule that one of two fields is filled."""
    space = F.lit(" \t ")
    code = F.concat(F.when(F.col("c_nationkey") % 2 == 0, "\n DRUGCENTRAL:").otherwise("x"), F.col("c_nationkey").cast("string"), F.lit("\t"))
    first, second = F.when(F.col("c_nationkey") % 3 == 1, "brand"), F.when(F.col("c_nationkey") % 3 == 2, "generic").otherwise("")
    return t(s, d, "customer").select("c_custkey", text.query_text(F.concat(space, "c_name", space)).alias("q"), text.local_code(code).alias("code"), validation.any_filled(first, second).alias("named"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 3 THEN 'frequency' END, CASE WHEN o_orderkey % 4000 > 3650 THEN 'duration' END, CASE WHEN o_orderkey % 5 = 0 THEN 'password' END, CASE WHEN o_orderkey % 150 > 100 THEN 'items' END) AS errors FROM orders""")
def validate_inputs(s, d):
    k = F.col("o_orderkey")
    rules = {
        "frequency": validation.matches(F.element_at(F.array(F.lit("1d"), F.lit("2D"), F.lit("3w"), F.lit("4d")), (k % 4 + 1).cast("int")), validation.FREQUENCY),
        "duration": validation.within((k % 4000).cast("string"), validation.DURATION_DAYS), "password": validation.strong(F.when(k % 5 == 0, "password1").otherwise("passw0rd!")),
        "items": validation.few(F.array_repeat(F.lit(1), (k % 150).cast("int"))),
    }
    return t(s, d, "orders").select("o_orderkey", F.concat_ws(",", validation.violations(rules)).alias("errors"))


@query("SELECT c_custkey, 'P-' || lpad((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::VARCHAR, 4, '0') || '-' || upper(substr(sha256(c_custkey::VARCHAR), 1, 4)) AS public_id FROM customer")
def public_ids(s, d):
    return details.public_ids(t(s, d, "customer"), ["c_nationkey"], "c_custkey").select("c_custkey", "public_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS shown, o_orderdate::DATE = DATE '1998-10-03' AS today FROM orders")
def display_dates(s, d):
    return t(s, d, "orders").select("o_orderkey", details.shown_date("o_orderdate").alias("shown"), (F.to_date("o_orderdate") == F.lit("1998-10-03").cast("date")).alias("today"))


@query("SELECT c_custkey, 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN '' ELSE chr(10) || 'balance: yes' END AS shown FROM customer")
def record_text(s, d):
    balance = F.when(F.col("c_acctbal") >= 0, "yes")
    return t(s, d, "customer").select("c_custkey", details.as_text({"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": balance}).alias("shown"))


@query("SELECT o_orderkey AS medicine, coalesce(p.brand, 'none') AS entered, p.brand AS generic, 'ACTIVE' AS status, 'prior-visit' AS source FROM orders LEFT JOIN (SELECT l_orderkey, min(p_brand) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) p ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def visits_as_medicines(s, d):
    own = t(s, d, "orders").select(F.col("o_orderkey").alias("consultation"), "o_orderstatus")
    visits = own.join(case(s, d)["consultations"].select("consultation", "proposed"), "consultation").where("o_orderstatus = 'F'")
    out = details.as_medicines(visits.withColumn("brand", F.coalesce("proposed", F.lit("none"))), "consultation", "brand", "proposed")
    return out.select("medicine", "entered", "generic", "status", "source")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)")
def nested_exists(s, d):
    """A condition on any of a record's nested children."""
    visits = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")
    nested = joins.nest_children(t(s, d, "customer").select("c_custkey"), visits, "c_custkey", ["o_orderkey", "o_orderstatus", "o_totalprice"], "visits")
    return nested.where(F.exists("visits", lambda v: (v["o_orderstatus"] == "P") & (v["o_totalprice"] > 300000))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), '1 auto') AND c_acctbal >= 0")
def concatenated_search(s, d):
    rows = t(s, d, "customer").withColumn("solvent", F.col("c_acctbal") >= 0)
    return details.listed(rows, ["c_name", "c_mktsegment"], "1 AUTO", {"solvent": True}).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer")
def filters_not_given(s, d):
    """Filters of which none is given leave every row."""
    return details.listed(t(s, d, "customer"), ["c_name"], "  ", {"c_nationkey": None, "c_mktsegment": None}).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(s, d):
    return t(s, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'BUILDING,rash' ELSE concat_ws(',', 'BUILDING', nullif(c_mktsegment, 'BUILDING'), 'rash') END AS items FROM customer")
def collection_edits(s, d):
    held = F.array_distinct(F.array(F.lit("BUILDING"), "c_mktsegment", F.lit("MACHINERY")))
    return t(s, d, "customer").select("c_custkey", F.array_join(merge.edited(held, F.array(F.lit("MACHINERY")), F.array(F.lit("rash"), F.lit("BUILDING"))), ",").alias("items"))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-02 00:00:00' AND ts + INTERVAL 15 MINUTE > TIMESTAMP '2024-01-02 00:00:00' AS valid FROM events")
def token_lifetime(s, d):
    from evidara.streaming.rates import alive

    return t(s, d, "events").select("event_id", alive("ts", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).alias("valid"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_custkey % 2 = 0)")
def hard_delete(s, d):
    return merge.without(t(s, d, "orders"), (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0)).select("o_orderkey")


@query("SELECT CASE o_orderstatus WHEN 'P' THEN 'created' ELSE 'updated' END AS action, count(*) AS n FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY ALL")
def audit_log(s, d):
    """Two appends to a log in the shared folder, read back."""
    path = files.new_path(s, "audit")
    for status, action in (("P", "created"), ("F", "updated")):
        rows = t(s, d, "orders").where(F.col("o_orderstatus") == status)
        details.audit(rows, F.col("o_custkey"), action, "order", F.col("o_orderkey"), F.col("o_orderdate")).write.mode("append").parquet(path)
    return s.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {DDI}, {ORDERS} SELECT o_orderkey AS consultation, CASE WHEN o_orderkey % 3 = 0 THEN 'e2' ELSE 'e1' END AS engine, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS result FROM orders""")
def snapshots(s, d):
    """Results kept by consultation, engine and hash of their input; a newer engine's are shown first."""
    hashes = ranking.input_hash(**case(s, d), pair_knowledge=pair_knowledge(s, d), disease_knowledge=disease_knowledge(s, d))
    hashes, _ = files.written(hashes, "hashes")
    old = hashes.select("consultation", F.lit("e1").alias("engine"), "input_hash", F.lit("old").alias("result"), F.lit(1).alias("stored_at"))
    new = hashes.where("consultation % 3 = 0").select("consultation", F.lit("e2").alias("engine"), "input_hash", F.lit("new").alias("result"), F.lit(2).alias("stored_at"))
    kept = details.stored(old, new)
    return details.shown(details.stored(kept, new)).select("consultation", "engine", "result")


@query("SELECT p_partkey, 'constant' AS provider, 10::BIGINT AS risk FROM part UNION ALL SELECT p_partkey, 'placeholder', floor(least(78, 8 + 7 * (p_size % 4) + p_size / 6.0::DOUBLE + ('0x' || substr(sha256('\"' || p_name || '\"'), 1, 8))::BIGINT % 19) + 0.5)::BIGINT FROM part")
def risk_providers(s, d):
    """The same input through two providers of predictions."""
    rows = t(s, d, "part").select("p_partkey", "p_name", "p_size", (F.col("p_size") % 4).alias("n"))
    constant = risk.Provider("constant", lambda df: df.withColumn("risk", F.lit(10)))
    own = risk.Provider("placeholder", lambda df: risk.predicted(df, "p_name", "p_size", "n"))
    return risk.asked(rows, [constant, own]).select("p_partkey", "provider", F.col("risk").cast("bigint").alias("risk"))


@query("SELECT l_orderkey AS consultation, count(*) AS n_active FROM (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N') GROUP BY ALL")
def active_counts(s, d):
    """The number of a record's active medicines, as a feature: the size of its nested list."""
    meds = case(s, d)["medicines"].where("status = 'ACTIVE'")
    nested = joins.nest_children(meds.select("consultation").distinct(), meds, "consultation", ["medicine"], "held")
    return nested.select("consultation", F.size("held").cast("bigint").alias("n_active"))


@query("SELECT p_brand AS pair, max(CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) AS best, arg_max(p_partkey, (CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END, p_size, -p_partkey)) AS id FROM part GROUP BY ALL")
def newest_of_best(s, d):
    """Of evidence of the highest severity the newest, then the first."""
    from evidara.functions import ordinal

    level = F.element_at(F.array(F.lit("MAJOR"), F.lit("MODERATE"), F.lit("MINOR")), F.col("p_size") % 3 + 1)
    rows = t(s, d, "part").select(F.col("p_brand").alias("pair"), F.col("p_partkey").alias("id"), F.col("p_size").alias("imported_at"), level.alias("severity"))
    won = dedup.first_wins(rows, ["pair"], [ordinal.rank("severity", ordinal.SEVERITY).desc(), F.col("imported_at").desc(), F.col("id").asc()])
    return won.select("pair", ordinal.rank("severity", ordinal.SEVERITY).alias("best"), "id")
