"""Projections, filters, scalar functions, aggregates and picks per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import hashing, ordinal, text, validation
from evidara.operators import dedup
from evidara.plans import reports, risk
from evidara.streaming.rates import rates

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT p_partkey AS part_id, p_name AS brand, p_type AS generic FROM part")
def scan_project_parts(s, d):
    return t(s, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("brand"), F.col("p_type").alias("generic"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND NOT c_acctbal < 0")
def filter_owner_not_deleted(s, d):
    return reports.owned(t(s, d, "customer"), "c_nationkey", 7, F.col("c_acctbal") < 0).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%00%7' OR c_mktsegment ILIKE '%auto%'")
def filter_ilike_or(s, d):
    return t(s, d, "customer").where(F.col("c_name").ilike("%00%7") | F.col("c_mktsegment").ilike("%auto%")).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def filter_prefix(s, d):
    return t(s, d, "part").where(F.col("p_name").startswith("red")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def filter_contains(s, d):
    return t(s, d, "part").where(F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_brand <> 'Brand#2'")
def filter_in(s, d):
    return t(s, d, "part").where(F.col("p_type").isin("PROMO", "SMALL") & (F.col("p_brand") != "Brand#2")).select("p_partkey")


@query("SELECT p_partkey, coalesce(nullif(nullif(p_name, 'red gear'), ''), nullif(p_type, 'PROMO'), 'none') AS shown FROM part")
def coalesce_truthy(s, d):
    name = F.when(F.col("p_name") == "red gear", "").otherwise(F.col("p_name"))
    kind = F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type"))
    return t(s, d, "part").select("p_partkey", F.coalesce(text.first_filled(name, kind), F.lit("none")).alias("shown"))


@query("""
SELECT c_custkey, concat_ws(',', CASE WHEN NOT regexp_matches(c_name, '^[A-Za-z][A-Za-z .''-]*$') THEN 'name' END,
  CASE WHEN NOT c_custkey % 200 BETWEEN 0 AND 130 THEN 'age' END, CASE WHEN NOT length(trim(c_mktsegment)) BETWEEN 1 AND 9 THEN 'segment' END) AS errors
FROM customer WHERE NOT (regexp_matches(c_name, '^[A-Za-z][A-Za-z .''-]*$') AND c_custkey % 200 BETWEEN 0 AND 130 AND length(trim(c_mktsegment)) BETWEEN 1 AND 9)""")
def validate_rows_quarantine(s, d):
    rules = {"name": validation.matches("c_name", validation.NAME), "age": validation.within(F.col("c_custkey") % 200, validation.AGE), "segment": validation.filled("c_mktsegment", 9)}
    _, bad = validation.quarantine(t(s, d, "customer"), rules)
    return bad.select("c_custkey", F.concat_ws(",", "errors").alias("errors"))


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS term_hash FROM documents")
def normalize_term_hash(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2(text.term("text"), 256).alias("term_hash"))


@query("""
SELECT DISTINCT p_partkey, CASE term WHEN 'small' THEN 'tiny' ELSE term END AS term FROM (
  SELECT p_partkey, trim(regexp_replace(lower(unnest(string_split_regex(p_name || ' + ' || p_type || '/' || p_type, '[+/]'))), '[^a-z0-9]+', ' ', 'g')) AS term FROM part)
WHERE term <> ''""")
def split_terms_explode(s, d):
    both = F.concat("p_name", F.lit(" + "), "p_type", F.lit("/"), "p_type")
    return t(s, d, "part").select("p_partkey", F.explode(text.ingredient_terms(both, {"small": "tiny"})).alias("term"))


@query("""
SELECT doc_id, nullif(regexp_extract(code, '^(?:UMLS:)?(C[0-9]{7})$', 1), '') AS cui,
  CASE WHEN doc_id % 3 = 0 THEN 'UMLS:C' || lpad(doc_id::VARCHAR, 7, '0') ELSE 'DRUGCENTRAL:v1:' || trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) END AS identity
FROM (SELECT doc_id, source, upper(trim(CASE WHEN doc_id % 3 = 0 THEN ' umls:c' ELSE 'x' END || lpad(doc_id::VARCHAR, 7, '0'))) AS code FROM documents)""")
def umls_code_extract(s, d):
    code = F.concat(F.when(F.col("doc_id") % 3 == 0, " umls:c").otherwise("x"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))
    docs = t(s, d, "documents").select("doc_id", "source", text.concept_code(code).alias("cui"), F.lit("v1").alias("version"))
    return docs.select("doc_id", "cui", text.identity("cui", "version", "source").alias("identity"))


_LABELS = {"1-URGENT": "contraindication", "2-HIGH": "warning", "3-MEDIUM": "precaution", "4-NOT SPECIFIED": "symptomatic treatment", "5-LOW": "off-label use"}


@query("""
SELECT o_orderkey, CASE WHEN regexp_matches(rel, 'contraindicat|avoid') THEN 'HIGH' WHEN regexp_matches(rel, 'warning|caution|not recommended') THEN 'MODERATE'
  WHEN regexp_matches(rel, 'precaution|monitor') THEN 'LOW' END AS assessment, regexp_matches(rel, 'indicat|treat|therapy|used for') AS indication,
  regexp_matches(rel, 'indicat|treat|therapy|used for') AND NOT contains(rel, 'contraindicat') AS strict_indication
FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'contraindication' WHEN '2-HIGH' THEN 'warning' WHEN '3-MEDIUM' THEN 'precaution'
  WHEN '4-NOT SPECIFIED' THEN 'symptomatic treatment' ELSE 'off-label use' END AS rel FROM orders)""")
def relationship_tiers(s, d):
    known = F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])
    rows = t(s, d, "orders").select("o_orderkey", known[F.col("o_orderpriority")].alias("rel"))
    return rows.select("o_orderkey", ordinal.tier("rel").alias("assessment"), ordinal.is_indication("rel").alias("indication"), ordinal.is_indication("rel", True).alias("strict_indication"))


@query("SELECT p_partkey, concat_ws(' | ', p_name, nullif(nullif(CASE WHEN p_size % 2 = 0 THEN '\\N' ELSE p_brand END, '\\N'), ''), p_type) AS evidence FROM part")
def evidence_concat(s, d):
    raw = F.when(F.col("p_size") % 2 == 0, "\\N").otherwise(F.col("p_brand"))
    return t(s, d, "part").select("p_partkey", text.evidence("p_name", text.dump_value(raw), "p_type").alias("evidence"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_name || '(' || p_size || 'mg)+' || p_type || '  (x)', '\\([^)]*\\)', '', 'g'), '\\s*\\+\\s*', ' + ', 'g'), '\\s+', ' ', 'g')) AS generic FROM part")
def canonical_generic(s, d):
    salt = F.concat("p_name", F.lit("("), F.col("p_size").cast("string"), F.lit("mg)+"), "p_type", F.lit("  (x)"))
    return t(s, d, "part").select("p_partkey", text.generic_name(salt).alias("generic"))


@query("""
SELECT o_orderkey, coalesce(CASE lower(raw) WHEN 'active' THEN 'ACTIVE' WHEN 'on-hold' THEN 'ON_HOLD' WHEN 'discontinued' THEN 'DISCONTINUED' END, 'ACTIVE') AS code,
  CASE lower(raw) WHEN 'on-hold' THEN 'on-hold' WHEN 'discontinued' THEN 'discontinued' ELSE 'active' END AS name
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'On-Hold' WHEN 'F' THEN 'discontinued' ELSE 'other' END AS raw FROM orders)""")
def status_codec(s, d):
    raw = F.when(F.col("o_orderstatus") == "O", "On-Hold").when(F.col("o_orderstatus") == "F", "discontinued").otherwise("other")
    rows = t(s, d, "orders").select("o_orderkey", ordinal.status_code(raw).alias("code"))
    return rows.select("o_orderkey", "code", ordinal.status_name("code").alias("name"))


@query("""SELECT p_partkey, sha256('{"brand":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '"' || p_name || '"' END || ',"size":' || p_size || '}') AS input_hash FROM part""")
def stable_hash(s, d):
    brand = F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("brand")
    return t(s, d, "part").select("p_partkey", hashing.stable_hash(brand, F.col("p_size").alias("size")).alias("input_hash"))


@query("""
WITH r AS (SELECT p_partkey, least(78, 8 + 7 * (p_size % 4) + p_size / 6.0::DOUBLE + ('0x' || substr(sha256('"' || p_name || '"'), 1, 8))::BIGINT % 19) AS risk,
  66 + ('0x' || substr(sha256('{"candidate":"' || p_name || '","type":"adr-demo-confidence"}'), 1, 8))::BIGINT % 26 AS confidence FROM part),
w AS (SELECT *, greatest(3, floor((100 - confidence) / 2.0::DOUBLE + 0.5)) AS width FROM r)
SELECT p_partkey, confidence, floor(risk + 0.5)::BIGINT AS risk, CASE WHEN risk >= 61 THEN 'High' WHEN risk >= 31 THEN 'Moderate' ELSE 'Low' END AS category,
  greatest(0, floor(risk - width + 0.5))::BIGINT AS lower, least(100, floor(risk + width + 0.5))::BIGINT AS upper FROM w""")
def hash_score(s, d):
    rows = t(s, d, "part").select("p_partkey", "p_name", "p_size", (F.col("p_size") % 4).alias("n"))
    out = risk.predicted(rows, "p_name", "p_size", "n")
    return out.select("p_partkey", "confidence", F.col("risk").cast("bigint").alias("risk"), "category", F.col("lower").cast("bigint").alias("lower"), F.col("upper").cast("bigint").alias("upper"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props(s, d):
    return t(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def date_bucket(s, d):
    return t(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT p_name, p_type, min(p_partkey) AS first_part FROM part GROUP BY ALL")
def dedup_first_wins(s, d):
    rows = t(s, d, "part").select("p_name", "p_type", F.col("p_partkey").alias("first_part"))
    return dedup.first_wins(rows, ["p_name", "p_type"], [F.col("first_part").asc()])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def distinct_on_latest(s, d):
    rows = t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return dedup.latest(rows, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def count_per_parent(s, d):
    n = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t(s, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 200000) AS large, bool_or(o_orderstatus = 'P') AS any_pending FROM orders GROUP BY ALL")
def conditional_counts(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"))


_SEVERITY = "CASE p_size % 5 WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'MINOR' WHEN 3 THEN 'strange' END"


@query(f"""
SELECT p_name, CASE max(CASE sev WHEN 'MAJOR' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'MINOR' THEN 1 ELSE 0 END) WHEN 3 THEN 'MAJOR' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'MINOR' ELSE 'NOT_EVALUATED' END AS severity
FROM (SELECT p_name, {_SEVERITY} AS sev FROM part) GROUP BY ALL""")
def ordinal_max(s, d):
    rows = t(s, d, "part").select("p_name", F.expr(_SEVERITY).alias("sev"))
    return rows.groupBy("p_name").agg(ordinal.highest("sev", ordinal.SEVERITY).alias("severity"))


@query(f"""
SELECT p_partkey, CASE WHEN sev = 'MAJOR' OR a = 'HIGH' THEN 'HIGH' WHEN sev = 'MODERATE' OR a = 'MODERATE' THEN 'MODERATE' WHEN sev = 'MINOR' OR a = 'LOW' THEN 'LOW' ELSE 'NOT_EVALUATED' END AS overall
FROM (SELECT p_partkey, {_SEVERITY} AS sev, CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'NOT_EVALUATED' END AS a FROM part)""")
def overall_synthesis(s, d):
    a = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'NOT_EVALUATED' END")
    return t(s, d, "part").select("p_partkey", ordinal.overall(F.expr(_SEVERITY), a).alias("overall"))


@query("SELECT p_brand, p_size, count(DISTINCT p_type) AS n, CASE count(DISTINCT p_type) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS resolution FROM part GROUP BY ALL")
def distinct_identity_gate(s, d):
    g = t(s, d, "part").groupBy("p_brand", "p_size").agg(F.count_distinct("p_type").alias("n"))
    return g.withColumn("resolution", F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS"))


@query("SELECT c_custkey, 'P-' || lpad((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::VARCHAR, 4, '0') AS public_id FROM customer")
def owner_sequence(s, d):
    rows = dedup.sequence(t(s, d, "customer"), ["c_nationkey"], [F.col("c_custkey").asc()])
    return rows.select("c_custkey", F.concat(F.lit("P-"), F.lpad(F.col("number").cast("string"), 4, "0")).alias("public_id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(s, d):
    return validation.duplicates(t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3")
def rate_window(s, d):
    return rates(t(s, d, "events"), "user_id", "ts", "6 hours", 3).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT doc_id, floor(((length(text) > 0)::INT + (quality IS NOT NULL)::INT + coalesce(toxic = 1, FALSE)::INT) * 100 / 3.0::DOUBLE + 0.5)::BIGINT AS complete FROM documents LEFT JOIN labels USING (doc_id)")
def completeness_ratio(s, d):
    rows = t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left")
    parts = (F.length("text") > 0, F.col("quality").isNotNull(), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return rows.select("doc_id", reports.complete(*parts).alias("complete"))


@query("SELECT event_type, user_id % 10 AS shard, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY ALL")
def event_ranges(s, d):
    return t(s, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("SELECT name, position, length(name) > 4 AS long_name FROM (VALUES ('Nausea', 1), ('Rash', 2), ('Dizziness', 3), ('Headache', 4), ('Diarrhea', 5), ('Fatigue', 6)) v(name, position)")
def constant_vocabulary(s, d):
    # The short list of adverse events.
    names = ["Nausea", "Rash", "Dizziness", "Headache", "Diarrhea", "Fatigue"]
    rows = s.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "name string, position int")
    return rows.withColumn("long_name", F.length("name") > 4)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'legacy' END AS omitted, p_name AS kept FROM part")
def drop_legacy_field(s, d):
    """A record loses a field, and a mark says so where it had a value."""
    result = F.struct(F.col("p_name").alias("kept"), F.when(F.col("p_size") % 2 == 0, F.lit("x")).alias("legacy"))
    rows = t(s, d, "part").select("p_partkey", result.alias("result"))
    out = rows.select("p_partkey", F.when(text.first_filled("result.legacy").isNotNull(), "legacy").alias("omitted"), F.col("result").dropFields("legacy").alias("result"))
    return out.select("p_partkey", "omitted", "result.kept")
