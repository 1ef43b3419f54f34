"""Changes in order, windows from first events, deletes across relations, loads of files, records without a schema, streams into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.bindings.basics import QUERIES, query, t
from evidara.functions import documents
from evidara.operators import containment, dedup, deletes, folds, search
from evidara.plans import knowledge
from evidara.sources import files
from evidara.streaming import tables

_ = QUERIES

_CHANGES = "c AS (SELECT event_id, user_id, value, CASE WHEN event_id % 3 > 0 THEN 1 + event_id % 5 END AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
#: Users under 120 are in the table at version 1 to 3, the others aren't; a change expects a version or none.
_FOLD = f"""WITH RECURSIVE {_CHANGES},
f AS (SELECT u.user_id, 0::BIGINT AS n, CASE WHEN user_id < 120 THEN 1 + user_id % 3 END AS version, ''::VARCHAR AS outcome FROM (SELECT DISTINCT user_id FROM events) u
UNION ALL SELECT f.user_id, c.n, CASE WHEN c.expected IS NULL OR c.expected = f.version THEN f.version + 1 ELSE f.version END, CASE WHEN f.version IS NULL THEN 'unknown' WHEN c.expected IS NULL OR c.expected = f.version THEN 'accepted' ELSE 'conflict' END FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)"""


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = t(s, d, "events")
    old = events.select("user_id").distinct().where("user_id < 120").select("user_id", (1 + F.col("user_id") % 3).alias("version"), F.lit(None).cast("double").alias("value"))
    return old, events.select("event_id", "user_id", "value", F.when(F.col("event_id") % 3 > 0, 1 + F.col("event_id") % 5).alias("expected"))


@query(f"{_FOLD} SELECT event_id, outcome, f.version AS new_version FROM f JOIN c USING (user_id, n)")
def version_conflicts(s, d):
    """Many changes a key, in order: each is accepted, in conflict with the version of its turn, or of an unknown key."""
    old, changes = _versions(s, d)
    return folds.ordered_changes(old, changes, "user_id", [F.col("event_id").asc()]).select("event_id", "outcome", "new_version")


@query(f"{_FOLD} SELECT user_id, max(f.version) AS version, arg_max(value, n) FILTER (outcome = 'accepted') AS value FROM f LEFT JOIN c USING (user_id, n) WHERE user_id < 120 GROUP BY ALL")
def version_table(s, d):
    """The table after all accepted changes."""
    old, changes = _versions(s, d)
    judged = folds.ordered_changes(old, changes, "user_id", [F.col("event_id").asc()])
    return folds.after_changes(old, judged, "user_id", F.col("event_id"), ["value"])


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, ts AS window_start, 1::BIGINT AS number FROM e WHERE n = 1
UNION ALL SELECT w.user_id, e.n, CASE WHEN e.ts >= w.window_start + INTERVAL 6 HOUR THEN e.ts ELSE w.window_start END, CASE WHEN e.ts >= w.window_start + INTERVAL 6 HOUR THEN 1 ELSE w.number + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, window_start, count(*) AS n, count(*) FILTER (number > 2) AS refused FROM w GROUP BY ALL""")
def first_event_windows(s, d):
    """Rate windows that open at a user's first event after the one before: events in each, and those over the limit."""
    rows = folds.first_event_windows(t(s, d, "events"), "user_id", "ts", 6 * 3600, 2, "event_id")
    return rows.groupBy("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("refused"))


_QUERIES = "q AS (SELECT p_partkey AS query_id, substr(CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_name END, 1 + p_partkey % 4, 1 + p_partkey % 7) AS query FROM part), v AS (SELECT p_partkey AS id, p_name, lower(p_type) AS kind, concat_ws(' ', p_name, lower(p_type)) AS shown FROM part)"


@query(f"""WITH {_QUERIES}, a AS (SELECT DISTINCT query FROM q),
b AS (SELECT query, id, shown FROM a JOIN v ON starts_with(p_name, query) OR starts_with(kind, query)),
i AS (SELECT query, id, shown FROM a JOIN v ON contains(p_name, query) OR contains(kind, query) WHERE query NOT IN (SELECT query FROM b)),
c AS (SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM i) QUALIFY row_number() OVER (PARTITION BY query ORDER BY shown, id) <= 400),
r AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY shown, id))::INT AS rank FROM c QUALIFY rank <= 5)
SELECT query_id, query, id, rank FROM q JOIN r USING (query)""")
def search_many(s, d):
    """A query for each part: prefixes of names or types, or parts of them, the first five of each."""
    part = t(s, d, "part")
    told = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_name"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.substring(told, (1 + F.col("p_partkey") % 4).cast("int"), (1 + F.col("p_partkey") % 7).cast("int")).alias("query"))
    rows = part.select(F.col("p_partkey").alias("id"), "p_name", F.lower("p_type").alias("kind"))
    return search.many(asked, rows, ["p_name", "kind"], ["id"], 5).select("query_id", "query", "id", "rank")


_FEW = "q AS (SELECT DISTINCT substr(p_name, 1 + p_partkey % 4, 1 + p_partkey % 3) AS query FROM part), v AS (SELECT p_partkey AS id, p_name AS indication, lower(p_type) AS generic FROM part)"


def _few(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select(F.substring("p_name", (1 + F.col("p_partkey") % 4).cast("int"), (1 + F.col("p_partkey") % 3).cast("int")).alias("query")).distinct()


@query(f"""WITH {_FEW}, b AS (SELECT query, id, indication FROM q JOIN v ON starts_with(indication, query)), i AS (SELECT query, id, indication FROM q JOIN v ON contains(indication, query) WHERE query NOT IN (SELECT query FROM b)),
c AS (SELECT * FROM (SELECT * FROM b UNION ALL SELECT * FROM i) QUALIFY row_number() OVER (PARTITION BY query ORDER BY indication, id) <= 400),
o AS (SELECT query, indication, min(id) AS id FROM c GROUP BY ALL) SELECT query, id, (row_number() OVER (PARTITION BY query ORDER BY indication, id))::INT AS rank FROM o QUALIFY rank <= 6""")
def search_many_indications(s, d):
    """Different names for each of many queries: repeats leave before the cut."""
    known = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("indication"))
    return search.many_indications(_few(s, d), known, 6).select("query", "id", "rank")


@query(f"""WITH {_FEW}, c AS (SELECT query, id, generic, NOT starts_with(generic, query) AS later FROM q JOIN v ON contains(generic, query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY generic, id) <= 400),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY later, generic, id) <= 40) SELECT query, generic, min(id) AS id FROM k GROUP BY ALL""")
def search_many_generics(s, d):
    """Generic names that contain each of many queries: repeats leave after the cut."""
    terms = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("generic"))
    return search.many_generics(_few(s, d), terms, 40).select("query", "generic", "id")


@query("""WITH a AS (SELECT DISTINCT substr(c_name, 1 + c_custkey % 9, 1 + c_custkey % 8) AS ask FROM customer WHERE substr(c_name, 1 + c_custkey % 9, 1 + c_custkey % 8) <> '')
SELECT ask, c_custkey, c_name FROM a JOIN customer ON contains(c_name, ask) QUALIFY row_number() OVER (PARTITION BY ask ORDER BY c_custkey) <= 3""")
def containment_index(s, d):
    """The first three customers whose name contains each of many texts."""
    rows = t(s, d, "customer").select("c_custkey", "c_name")
    asks = rows.select(F.substring("c_name", (1 + F.col("c_custkey") % 9).cast("int"), (1 + F.col("c_custkey") % 8).cast("int")).alias("_ask")).where("_ask <> ''").distinct()
    return containment.containing(asks, rows, ["c_name"], [F.col("c_custkey").asc()], 3, ["c_custkey"]).withColumnRenamed("_ask", "ask")


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), held AS (SELECT c_custkey FROM gone WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')),
c AS (SELECT c_custkey FROM gone WHERE c_custkey NOT IN (SELECT c_custkey FROM held)),
o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM c) UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND o_orderstatus <> 'P'),
l AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) GROUP BY ALL)
SELECT 'customer' AS relation, c_custkey::VARCHAR AS key, 'removed' AS outcome, NULL::VARCHAR AS column FROM c UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'removed', NULL FROM o UNION ALL SELECT 'lineitem', k, 'removed', NULL FROM l
UNION ALL SELECT 'events', event_id::VARCHAR, 'nulled', 'user_id' FROM events WHERE user_id IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'refused', NULL FROM held UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'refused', NULL FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'removed', NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'nation', '-1', 'unknown', NULL""")
def delete_cascade(s, d):
    """Deletes of customers, orders and nations: orders and their lines go with them, events lose their user, open orders and customers refuse."""
    orders = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lines = t(s, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("k"), "l_orderkey").distinct()
    customer = t(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal")
    nation = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    done, open_ = orders.where("o_orderstatus <> 'P'"), orders.where("o_orderstatus = 'P'")
    relations = {"nation": (nation, "n_nationkey"), "customer": (customer, "c_custkey"), "orders": (done, "o_orderkey"), "open": (open_, "o_orderkey"), "lineitem": (lines, "k"), "events": (t(s, d, "events").select("event_id", "user_id"), "event_id")}
    references = [
        deletes.Reference("customer", "c_nationkey", "nation"), deletes.Reference("orders", "o_custkey", "customer", deletes.CASCADE), deletes.Reference("open", "o_custkey", "customer"),
        deletes.Reference("lineitem", "l_orderkey", "orders", deletes.CASCADE), deletes.Reference("events", "user_id", "customer", deletes.SET_NULL),
    ]
    gone = {"customer": customer.where("c_acctbal < 0"), "orders": done.where("o_totalprice > 400000"), "nation": nation.union(s.createDataFrame([(-1,)], "n_nationkey long"))}
    return deletes.deleted(relations, references, gone)


#: Rows of a source file: each of so many is written by one task.
ROWS_A_FILE = 500


def source_files(s: SparkSession, rows: DataFrame, before: list[str], after: list[str] = (), compression: str = "none", what: str = "source") -> str:
    """A folder of text files of rows (key, value) in ranges of ROWS_A_FILE keys, each with the lines `before` and `after`; files are named in the order of their keys."""
    path = files.new_path(s, what)
    ranged = rows.select(F.format_string("%09d", F.floor(F.col("key") / ROWS_A_FILE)).alias("bucket"), F.lit(1).alias("o"), "key", "value")
    marks = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k).cast("long").alias("key"), F.lit(v).alias("value")) for o, lines in ((0, before), (2, after)) for k, v in enumerate(lines)])
    marked = ranged.union(ranged.select("bucket").distinct().select("bucket", F.explode(marks).alias("m")).select("bucket", "m.*"))
    marked.repartition("bucket").sortWithinPartitions("bucket", "o", "key").select("bucket", "value").write.partitionBy("bucket").option("compression", compression).text(path)
    return path


_RELATED = """r AS (SELECT p_partkey AS k, p_name AS generic, CASE p_size % 5 WHEN 0 THEN 'contraindication' WHEN 1 THEN 'indication' WHEN 2 THEN 'use with caution' WHEN 3 THEN 'monitor' ELSE 'off-label use' END AS relationship,
CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS concept, CASE WHEN p_partkey % 4 > 0 THEN 'C' || lpad((p_partkey % 9000)::VARCHAR, 7, '0') END AS cui, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS snomed FROM part),
k AS (SELECT *, lower(replace(coalesce(snomed, concept), '#', ' ')) AS disease FROM r WHERE coalesce(snomed, concept) IS NOT NULL)"""


def _dump(s: SparkSession, d: str) -> list[str]:
    """A gzip dump of several files, each with two sections: drugs' names, and what is known of them."""
    part = t(s, d, "part")
    filler = [F.lit("x")] * 8
    names = part.select(F.col("p_partkey").alias("key"), F.concat_ws("\t", F.col("p_partkey").cast("string"), *filler, F.col("p_name")).alias("value"))
    wording = F.element_at(F.array(*[F.lit(x) for x in ("contraindication", "indication", "use with caution", "monitor", "off-label use")]), F.col("p_size") % 5 + 1)
    k = F.col("p_partkey")
    cells = [F.lit("9"), k.cast("string"), F.lit("7"), wording, F.when(k % 2 == 0, F.lower("p_type")).otherwise("\\N"), F.when(k % 4 > 0, F.concat(F.lit("C"), F.lpad((k % 9000).cast("string"), 7, "0"))).otherwise("\\N"), F.when(k % 3 > 0, F.col("p_brand")).otherwise("")]
    facts = part.select(k.alias("key"), F.concat_ws("\t", *cells).alias("value"))
    one = source_files(s, names, ["COPY public.structures (id, name) FROM stdin;"], ["\\."], "gzip", "dump")
    two = source_files(s, facts, ["SET x = 1;", "COPY public.omop_relationship (id, struct_id) FROM stdin;"], ["\\.", "", "COPY public.others (id) FROM stdin;", "7\tx", "\\."], "gzip", "dump")
    return [f"{one}/*", f"{two}/*"]


@query(f"""WITH {_RELATED} SELECT 'disease' AS relation, lower(generic) AS drug, disease, CASE WHEN cui IS NOT NULL THEN 'UMLS:' || cui ELSE 'DRUGCENTRAL:v1:' || disease END AS identity,
CASE relationship WHEN 'contraindication' THEN 'HIGH' WHEN 'use with caution' THEN 'MODERATE' WHEN 'monitor' THEN 'LOW' END AS assessment, concat_ws(' | ', relationship, concept, cui) AS evidence FROM k WHERE relationship IN ('contraindication', 'use with caution', 'monitor')
UNION ALL SELECT 'indication', lower(generic), disease, NULL, relationship, concat_ws(' | ', relationship, concept, cui) FROM k WHERE relationship IN ('contraindication', 'indication')""")
def dump_relations(s, d):
    """Two relations out of one parse of a compressed dump."""
    parsed = files.parsed_dump(s, _dump(s, d))
    rows = knowledge.relationships(parsed, "v1")
    ill = knowledge.diseases(rows).select(F.lit("disease").alias("relation"), "drug", "disease", "identity", "assessment", "evidence")
    return ill.union(knowledge.indications(rows).select(F.lit("indication"), F.col("normalised"), F.col("indication"), F.lit(None).cast("string"), F.col("relationship"), F.col("evidence")))


@query("SELECT (20240101 + p_partkey // 500)::VARCHAR AS named, TRUE AS dated, count(*) + 1 AS n_lines FROM part GROUP BY ALL")
def file_versions(s, d):
    """The version in each source file's own name, its date of change, and its lines."""
    path = source_files(s, t(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")), ["name"])
    where = s._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(s._jsc.hadoopConfiguration())
    for i, status in enumerate(fs.globStatus(where(f"{path}/bucket=*/part-*"))):  # one a file, in the order of their keys
        fs.rename(status.getPath(), where(status.getPath().getParent(), f"knowledge_{20240101 + i}.csv"))
    known = files.version(s, f"{path}/*/*.csv").select("path", "named", F.col("changed").isNotNull().alias("dated"))
    n = s.read.text(f"{path}/*/*.csv").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_lines"))
    return known.join(n, "path").select("named", "dated", "n_lines")


def _import_rows(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Rows of the four relations, by rules on parts: the keys of some come twice."""
    part, none = t(s, d, "part"), F.lit(None).cast("string")
    src, ver = F.lit("DrugCentral").alias("source"), F.lit("v1").alias("version")
    marked = F.when(F.col("p_partkey") % 11 == 0, F.lit("\\N")).otherwise(none).alias("cui")
    source = F.when(F.col("p_partkey") % 2 == 0, "DrugCentral").otherwise("Other").alias("source")
    return {
        "terminology": part.select(F.col("p_name").alias("brand"), F.col("p_name").alias("normalised_brand"), F.col("p_type").alias("generic"), F.lower("p_type").alias("normalised_generic"), src, ver, "p_size"),
        "interactions": part.select(F.col("p_name").alias("drug_a"), F.col("p_brand").alias("drug_b"), F.least("p_name", "p_brand").alias("a"), F.greatest("p_name", "p_brand").alias("b"), F.lit("MINOR").alias("severity"), src, ver, "p_size"),
        "diseases": part.select(F.col("p_name").alias("generic"), F.col("p_name").alias("drug"), F.lit("I").alias("identity"), F.concat_ws(" ", "p_type", "p_partkey").alias("disease"), none.alias("concept"), none.alias("snomed"), marked, F.lit("rel").alias("relationship"), F.lit("LOW").alias("assessment"), F.lit("e").alias("evidence"), source, ver, "p_size"),
    }


@query("""WITH i AS (SELECT DISTINCT least(p_name, p_brand) AS a, greatest(p_name, p_brand) AS b, p_size >= 25 AS new FROM part), m AS (SELECT DISTINCT p_name, p_type, p_size >= 25 AS new FROM part)
SELECT 'terminology' AS relation, (SELECT count(*) FROM part WHERE p_size >= 25) AS processed, (SELECT count(*) FROM m WHERE new AND (p_name, p_type) NOT IN (SELECT (p_name, p_type) FROM m WHERE NOT new)) AS inserted, (SELECT count(*) FROM (SELECT DISTINCT p_name, p_type FROM part)) AS rows
UNION ALL SELECT 'interactions', (SELECT count(*) FROM part WHERE p_size >= 25), (SELECT count(*) FROM i WHERE new AND (a, b) NOT IN (SELECT (a, b) FROM i WHERE NOT new)), (SELECT count(*) FROM (SELECT DISTINCT a, b FROM i))
UNION ALL SELECT 'diseases', (SELECT count(*) FROM part WHERE p_size >= 25), (SELECT count(*) FROM part WHERE p_size >= 25), (SELECT count(*) FROM part WHERE p_size >= 25 OR NOT (p_partkey % 11 = 0 AND p_partkey % 2 = 0))
UNION ALL SELECT 'indications', 0, 0, 0""")
def knowledge_import(s, d):
    """The four relations loaded from a folder in one call: names and pairs are ignored where they are known, diseases replaced after a purge of one source's marks, a file is missing."""
    folder = files.new_path(s, "processed")
    old = {}
    for name, rows in _import_rows(s, d).items():
        file, _, keys, _ = knowledge.RELATIONS[name]
        files.write_ndjson(rows.where("p_size >= 25").drop("p_size"), f"{folder}/{file}")
        known = rows.where("p_size < 25").drop("p_size")
        old[name] = dedup.first_wins(known, keys, [F.col(c).asc_nulls_last() for c in known.columns])
    old["indications"] = s.createDataFrame([], knowledge.RELATIONS["indications"][1])
    after, counts = knowledge.import_all(s, folder, old, "DrugCentral")
    sizes = [df.agg(F.lit(name).alias("relation"), F.count("*").alias("rows")) for name, df in after.items()]
    held = sizes[0].union(sizes[1]).union(sizes[2]).union(sizes[3])
    return counts.join(held, "relation")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'record' WHEN 1 THEN 'list' WHEN 2 THEN 'text' ELSE 'none' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN p_type END AS found,
CASE p_partkey % 4 WHEN 0 THEN '{"name":"' || p_name || '","size":' || p_size || ',"tags":["' || p_brand || '"]}' WHEN 1 THEN '["' || p_type || '",' || p_size || ']' WHEN 2 THEN '"' || p_name || '"' END AS kept FROM part""")
def variant_records(s, d):
    """Records, lists, texts and what isn't JSON in one column: looked into by paths, a field dropped, stored and written back."""
    k = F.col("p_partkey") % 4
    own = F.to_json(F.struct(F.col("p_size").alias("size"), F.lit("x").alias("legacy"), F.array("p_brand").alias("tags"), F.col("p_name").alias("name")))
    raw = F.when(k == 0, own).when(k == 1, F.format_string('["%s", %d]', "p_type", "p_size")).when(k == 2, F.format_string('"%s"', "p_name")).otherwise("{not json")
    rows, _ = files.written(t(s, d, "part").select("p_partkey", documents.without(documents.parsed(raw), "legacy").alias("doc")), "records")
    kind = F.when(documents.is_object("doc"), "record").when(documents.shape("doc").startswith("ARRAY"), "list").when(F.col("doc").isNotNull(), "text").otherwise("none")
    return rows.select("p_partkey", kind.alias("kind"), documents.at("doc", "$.size", "int").alias("size"), F.coalesce(documents.at("doc", "$.tags[0]"), documents.at("doc", "$[0]")).alias("found"), documents.written("doc").alias("kept"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stream_upsert(s, d):
    """A stream of events merged into a table of the last one a user; the same events come a second time and change nothing."""
    rows = t(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    inbox, table, state = (files.new_path(s, x) for x in ("inbox", "table", "state"))
    for _ in range(2):
        rows.write.mode("append").parquet(inbox)
        stream = s.readStream.schema(rows.schema).parquet(inbox)
        tables.upsert_stream(stream, table, state, ["user_id"], "ts", "event_id", "40 days").awaitTermination()
    last = tables.latest(s, table, rows.schema, ["user_id"], "ts", "event_id")
    return last.select("user_id", "event_type", "event_id")


@query("SELECT event_type, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM events GROUP BY ALL")
def stream_log(s, d):
    """An append-only log of a stream that comes in two parts, each written once."""
    from evidara.streaming.rates import append_log

    rows = t(s, d, "events").select("event_id", "event_type")
    inbox, log, state = (files.new_path(s, x) for x in ("inbox", "log", "state"))
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        part.write.mode("append").parquet(inbox)
        append_log(s.readStream.schema(rows.schema).parquet(inbox), log, state).awaitTermination()
    return s.read.schema(rows.schema).parquet(log).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


@query("SELECT o_orderkey, 10 * (o_custkey % 3) + row_number() OVER (PARTITION BY o_custkey % 7, o_custkey % 3 ORDER BY o_orderkey) AS number FROM orders")
def sequence_goes_on(s, d):
    """Numbers of a few large owners, after those that they have given already."""
    rows = t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("a"), (F.col("o_custkey") % 3).alias("b"))
    given = rows.where("b > 0").select("a", "b", (10 * F.col("b")).alias("last")).distinct()
    return dedup.sequence(rows, ["a", "b"], [F.col("o_orderkey").asc()], given=given).select("o_orderkey", F.col("number").cast("bigint").alias("number"))


@query("SELECT p_partkey FROM part WHERE NOT (p_size % 3 > 0 AND (p_size % 5 = 0 OR p_partkey % 7 = 0))")
def purge_of_source(s, d):
    """Rows with the dump's mark of null are purged of one source; those of another one stay."""
    rows = t(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "\\N").alias("x"), F.when(F.col("p_partkey") % 7 == 0, "\\N").otherwise("y").alias("y"), F.when(F.col("p_size") % 3 > 0, "DrugCentral").otherwise("Other").alias("source"))
    return knowledge.purged(rows, "x", "y", source="DrugCentral").select("p_partkey")


