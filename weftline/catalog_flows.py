"""More queries: traced flows, context of a node, call graphs, virtual nodes and change scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import on_graph, query
from .catalog_rules import TITLE, cases, on_symbols
from .functions import rules
from .operators import aggregates as agg
from .operators import flows as flw
from .operators import relational as rel
from .operators import renderers as out
from .plans.graph import Graph, table
from .plans.symbols import _list, _pick

#: What a customer reaches over orders and parts, at its least depth.
REACHED = "r AS (SELECT id AS seed, id, 0 AS depth FROM g_nodes WHERE node_type = 'CUSTOMER' UNION ALL SELECT DISTINCT from_id, to_id, 1 FROM g_edges WHERE relation = 'PLACES' UNION ALL SELECT DISTINCT a.from_id, b.to_id, 2 FROM g_edges a JOIN g_edges b ON a.to_id = b.from_id WHERE a.relation = 'PLACES' AND b.relation = 'CONTAINS')"
Q = r"'''' || replace(replace({}, '\', '\\'), '''', '\''') || ''''"


# --- flows ----------------------------------------------------------------------------
@on_graph("grf_12_endpoint_flows", "SELECT DISTINCT flow AS seed, id, depth FROM (SELECT to_id AS flow, unnest([to_id, from_id]) AS id, unnest([0, 1]) AS depth FROM g_edges WHERE relation = 'PLACES' UNION ALL SELECT o.to_id, c.to_id, 2 FROM g_edges o JOIN g_edges c ON o.from_id = c.from_id AND c.relation = 'BELONGS_TO' WHERE o.relation = 'PLACES' UNION ALL SELECT o.to_id, n.to_id, 3 FROM g_edges o JOIN g_edges c ON o.from_id = c.from_id AND c.relation = 'BELONGS_TO' JOIN g_edges n ON c.to_id = n.from_id AND n.relation = 'BELONGS_TO' WHERE o.relation = 'PLACES')")
def _(g):
    return flw.endpoint_flows(g, rel.by_type(g, "ORDER"), ["PLACES"], ["BELONGS_TO"])


@on_graph("grf_13_controller_flows", "SELECT seed, id, depth FROM r", recursive=REACHED)
def _(g):
    return flw.trace(g, flw.seeds(rel.by_type(g, "CUSTOMER")), ["PLACES", "CONTAINS"], 8)


@on_graph("grf_14_call_chains", "SELECT seed, step, id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS step FROM r) WHERE step <= 6", recursive=REACHED)
def _(g):
    return flw.trace(g, flw.seeds(rel.by_type(g, "CUSTOMER")), ["PLACES", "CONTAINS"], 6, most=6).select("seed", "step", "id")


ROOTS = "s AS (SELECT id FROM g_nodes WHERE node_type IN ('CUSTOMER', 'SUPPLIER') AND id NOT IN (SELECT to_id FROM g_edges) AND id IN (SELECT from_id FROM g_edges GROUP BY 1 HAVING count(*) >= 2) AND id IN (SELECT from_id FROM g_edges WHERE relation IN ('PLACES', 'SUPPLIES')) ORDER BY id LIMIT 10)"
ROOT_CHAINS = f"{ROOTS}, e AS (SELECT DISTINCT from_id, to_id FROM g_edges WHERE relation IN ('PLACES', 'SUPPLIES', 'CONTAINS')), r AS (SELECT seed, id, min(depth) AS depth FROM (SELECT id AS seed, id, 0 AS depth FROM s UNION ALL SELECT from_id, to_id, 1 FROM e JOIN s ON s.id = from_id UNION ALL SELECT a.from_id, b.to_id, 2 FROM e a JOIN s ON s.id = a.from_id JOIN e b ON a.to_id = b.from_id) GROUP BY ALL)"


@on_graph("grf_15_root_workflows", "SELECT seed, count(*) AS n, string_agg(name, ' → ' ORDER BY step) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS step FROM r) JOIN g_nodes USING (id) WHERE step <= 5 GROUP BY seed", recursive=ROOT_CHAINS)
def _(g):
    relations = ["PLACES", "SUPPLIES", "CONTAINS"]
    leads = g.edges.where(F.col("relation").isin(*relations)).select(F.col("from_id").alias("id"))
    first = flw.roots(g, ["CUSTOMER", "SUPPLIER"]).join(leads, "id", "left_semi").orderBy("id").limit(10)  # a report of ten, as in the reference
    return flw.named_steps(g, flw.trace(g, flw.seeds(first), relations, 5, most=5), " → ")


@on_graph("grf_17_request_flows", "SELECT seed, count(*) AS n, string_agg(name, ' > ' ORDER BY step) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS step FROM r) JOIN g_nodes USING (id) WHERE step <= 8 GROUP BY seed", recursive="r AS (SELECT id AS seed, id, 0 AS depth FROM g_nodes WHERE node_type = 'SUPPLIER' UNION ALL SELECT from_id, to_id, 1 FROM g_edges WHERE relation = 'SUPPLIES')")
def _(g):
    return flw.named_steps(g, flw.trace(g, flw.seeds(rel.by_type(g, "SUPPLIER")), ["SUPPLIES"], 8, most=8), " > ")


@on_graph("grf_20_longest_paths", "SELECT id, max(length) AS length, arg_max(path, length) AS path FROM (SELECT DISTINCT unnest([from_id, to_id]) AS id, 1 AS length, id AS path FROM b UNION ALL SELECT to_id, 2, min(from_id || '>' || to_id) FROM b GROUP BY to_id UNION ALL SELECT y.to_id, 3, min(x.from_id || '>' || x.to_id || '>' || y.to_id) FROM b x JOIN b y ON x.to_id = y.from_id GROUP BY y.to_id) GROUP BY id", recursive="b AS (SELECT from_id, to_id FROM g_edges WHERE relation = 'BELONGS_TO')")
def _(g):
    return flw.longest_paths(rel.by_relation(g, "BELONGS_TO").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


# --- context of a node ------------------------------------------------------------------
RESOLVED = "q AS (SELECT id AS query FROM g_nodes WHERE node_type = 'SUPPLIER' UNION SELECT name FROM g_nodes WHERE node_type IN ('NATION', 'REGION') UNION SELECT domain FROM g_nodes WHERE domain IS NOT NULL UNION SELECT 'no such node'), k AS (SELECT id AS k, 0 AS r, id FROM g_nodes UNION ALL SELECT lower(name), 1, min(id) FROM g_nodes GROUP BY 1 UNION ALL SELECT lower(service), 2, min(id) FROM g_nodes GROUP BY 1 UNION ALL SELECT lower(domain), 3, min(id) FROM g_nodes GROUP BY 1), h AS (SELECT query, arg_min(id, r) AS id, min(r) AS r FROM q JOIN k ON k = CASE WHEN r = 0 THEN query ELSE lower(query) END GROUP BY query)"


@on_graph("ctx_01_resolved", "SELECT query, id, ['id', 'name', 'service', 'domain'][r + 1] AS how FROM q LEFT JOIN h USING (query)", recursive=RESOLVED)
def _(g):
    t, n = F.col("node_type"), g.nodes
    asked = n.where(t == "SUPPLIER").select("id").unionAll(n.where(t.isin("NATION", "REGION")).select("name")).unionAll(n.where("domain is not null").select("domain")).distinct().toDF("query")
    return flw.resolve(g, asked.unionAll(g.nodes.sparkSession.createDataFrame([("no such node",)], "query string")))


@on_graph("ctx_02_neighbourhood", "SELECT seed, id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS step FROM r) WHERE step <= 80", recursive="r AS (SELECT to_id AS seed, from_id AS id, 1 AS depth FROM g_edges WHERE to_id LIKE 'region%' UNION ALL SELECT y.to_id, x.from_id, 2 FROM g_edges x JOIN g_edges y ON x.to_id = y.from_id WHERE y.to_id LIKE 'region%')")
def _(g):
    found = flw.trace(g, flw.seeds(rel.by_type(g, "REGION")), ["BELONGS_TO"], 2, most=81, direction="in")
    return found.where("depth > 0").select("seed", "id", "depth")


@on_graph("ctx_05_relation_sections", "SELECT e.id, direction, relation, count(*) AS n, min(name) AS first_name FROM (SELECT from_id AS id, to_id AS other, relation, 'out' AS direction FROM g_edges UNION ALL SELECT to_id, from_id, relation, 'in' FROM g_edges) e JOIN g_nodes o ON o.id = other GROUP BY ALL")
def _(g):
    return flw.relation_sections(g)


@on_graph("ctx_06_positions", "SELECT id, coalesce(a, 0) AS n_before, coalesce(b, 0) AS n_after, CASE WHEN a > 0 AND b > 0 THEN 'inner' WHEN b > 0 THEN 'entry' WHEN a > 0 THEN 'exit' ELSE 'alone' END AS position FROM g_nodes LEFT JOIN (SELECT to_id AS id, count(*) AS a FROM g_edges GROUP BY 1) USING (id) LEFT JOIN (SELECT from_id AS id, count(*) AS b FROM g_edges GROUP BY 1) USING (id)")
def _(g):
    return flw.positions(g)


@on_graph("fil_06_flow_members", "SELECT id, name FROM g_nodes WHERE contains(lower(name), 'build') OR contains(lower(domain), 'build')")
def _(g):
    has = lambda c: F.contains(F.lower(c), F.lit("build"))
    return g.nodes.where(has("name") | has("domain")).select("id", "name")


@on_graph("fil_27_projected", "SELECT id, substr(name, 1, 200) AS name, array_to_string(string_split(name, ' ')[1:5], '|') AS tags FROM g_nodes")
def _(g):
    return g.nodes.select("id", F.substring("name", 1, 200).alias("name"), F.array_join(F.slice(F.split("name", " "), 1, 5), "|").alias("tags"))


# --- calls and symbols --------------------------------------------------------------------
@on_symbols("rel_07_call_graph", ", f AS (SELECT path, name, arg_min(category, list_position(['FUNCTION', 'ASYNC_DEF', 'METHOD'], category)) AS t FROM sym WHERE category IN ('FUNCTION', 'ASYNC_DEF', 'METHOD') GROUP BY ALL), c AS (SELECT a.path AS source, a.name AS caller, b.path AS target, b.name AS callee FROM sym a JOIN sym b ON b.id = a.id + 1) SELECT DISTINCT CASE WHEN d.t IS NULL THEN source ELSE f.t || '::' || source || '::' || caller END AS from_key, CASE WHEN d.t IS NULL THEN target ELSE d.t || '::' || target || '::' || callee END AS to_key, CASE WHEN d.t IS NULL THEN 'DEPENDS_ON' ELSE 'CALLS' END AS relation FROM c JOIN f ON f.path = source AND f.name = caller LEFT JOIN f d ON d.path = target AND d.name = callee")
def _(s):
    following = s.select((F.col("id") - 1).alias("id"), F.col("path").alias("target"), F.col("name").alias("callee"))
    return flw.call_edges(s, s.select("id", F.col("path").alias("source"), F.col("name").alias("caller")).join(following, "id").drop("id"))


@on_symbols("tag_05_control_flow", ", n AS (SELECT id AS from_id, id + 1 AS to_id, regexp_matches(lower(body), 'if |if\\(|switch |match |try |try:|try\\{') AS branches, regexp_matches(lower(body), 'try |try:|try\\{') AS tries FROM sym), e AS (SELECT n.*, regexp_matches(lower(name), 'error|exception|catch|handler|fallback') AS error FROM n JOIN sym ON id = to_id) SELECT from_id, to_id, 'CONTROL_FLOW' AS relation FROM e WHERE branches UNION ALL SELECT from_id, to_id, 'RETURNS_TO' FROM e WHERE tries AND error")
def _(s):
    return flw.control_edges(s, s.select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id")))


@query("fun_34_purposes", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name || ' ' || p_type), '{w}') THEN '{says}.'" for w, says in rules.PURPOSES) + f" WHEN p_size > 25 THEN 'Exposes REST API endpoints for ' || {TITLE.format('p_name')} || ' operations and external integration.' ELSE 'Manages ' || {TITLE.format('p_name')} || ' operations and logic within the domain.' END AS purpose FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.purpose(F.col("p_name"), F.col("p_type"), F.col("p_size") > 25).alias("purpose"))


STAGES = ["Steel Bolt", "Widget", "Cold"]


@query("rel_49_stage_names", "SELECT p_partkey, coalesce(list_filter(['" + "', '".join(STAGES) + f"'], lambda x: contains(lower(p_name), lower(x)) OR contains(lower(x), lower(p_name)))[1], {TITLE.format('p_name')}) AS stage FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", flw.stage_name(F.col("p_name"), STAGES).alias("stage"))


# --- partitions, virtual nodes, scripts -------------------------------------------------------
@on_graph("rel_33_partition_delta", "SELECT coalesce(service, '__default__') AS partition, CASE WHEN count(*) FILTER (WHERE node_type <> 'ORDER') = 0 THEN 'added' WHEN count(*) FILTER (WHERE node_type = 'ORDER') > 0 THEN 'changed' ELSE 'unchanged' END AS state FROM g_nodes GROUP BY 1")
def _(g):
    return agg.delta(agg.manifest(Graph(g.nodes.where("node_type <> 'ORDER'"), g.edges)), agg.manifest(g))


@on_graph("tag_06_virtual_edges", "SELECT id AS from_id, 'service_cluster__' || service AS to_id, 'BELONGS_TO_SERVICE' AS relation FROM g_nodes WHERE service IS NOT NULL UNION ALL SELECT id, 'business_flow__' || domain, 'PARTICIPATES_IN_FLOW' FROM g_nodes WHERE domain IS NOT NULL")
def _(g):
    return flw.virtual_edges(g)


@on_graph("snk_18_change_script", f"SELECT 'node' AS kind, (row_number() OVER (ORDER BY id) - 1) // 500 AS batch, 'MERGE (n:' || node_type || ' {{id: ' || {Q.format('id')} || '}}) SET n.name = ' || {Q.format('substr(name, 1, 200)')} || ', n.node_type = ' || {Q.format('node_type')} || ';' AS line FROM g_nodes UNION ALL SELECT 'edge', (row_number() OVER (ORDER BY from_id, to_id) - 1) // 500, 'MATCH (a {{id: ''' || from_id || '''}}), (b {{id: ''' || to_id || '''}}) MERGE (a)-[:' || relation || ']->(b);' FROM g_edges UNION ALL SELECT 'delete', 0, 'MATCH (n) WHERE n.partition_id = ' || {Q.format('r_name')} || ' DETACH DELETE n;' FROM region")
def _(g):
    return flw.change_script(g.nodes, g.edges, rel.by_type(g, "REGION").select(F.col("name").alias("partition")))


@on_graph("snk_12_merge_script", f"SELECT id, 'MERGE (n:' || node_type || ' {{id: ' || {Q.format('id')} || '}});' AS line FROM g_nodes")
def _(g):
    return g.nodes.select("id", F.concat(F.lit("MERGE (n:"), "node_type", F.lit(" {id: "), out.quoted(F.col("id")), F.lit("});")).alias("line"))


@on_graph("rel_41_selected_flows", "SELECT id, service FROM g_nodes WHERE node_type = 'ORDER' AND service IN (SELECT service FROM g_nodes WHERE service IS NOT NULL GROUP BY service ORDER BY count(*) DESC, service LIMIT 2)")
def _(g):
    largest = g.nodes.where("service is not null").groupBy("service").count().orderBy(F.desc("count"), "service").limit(2)  # the two largest services
    return g.nodes.where("node_type = 'ORDER'").join(largest, "service", "left_semi").select("id", "service")


@query("src_15_latest_events", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "event_type")  # a report of the latest


@query("agg_28_capabilities", "SELECT capability, count(*) AS n FROM (SELECT string_split(p_name, ' ')[-1] AS capability FROM part) GROUP BY capability ORDER BY n DESC, capability LIMIT 7")
def _(spark, d):
    parts = table(spark, d, "part").select(F.element_at(F.split("p_name", " "), -1).alias("capability"))
    return parts.groupBy("capability").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "capability").limit(7)


# --- detectors ---------------------------------------------------------------------------------
#: Texts and names that the detectors are to find, dealt to symbols and parts by their key.
USES = ["KafkaProducer.send(x)", "amqp consume", "huey task", "emit(order)", "bull queue handler", "nats on_message", "plain", "postgres://h/db", "import redis", "from pymongo import x", "mysql+pymysql://h", "sqlite:///x", "airflow dag"]
FIELDS = ["customer_id", "created", "is_active", "price", "qty", "email", "notes", "tags", "item_map", "log_dir", "total", "status"]
METHODS = ["get_order", "get", "update_stock", "build", "create_part", "parse_file", "validate_all", "Run_Fast", "check"]
USED_SQL = f", u AS (SELECT *, body || ' ' || {_list(USES)}[id % {len(USES)} + 1] AS t FROM sym)"


def used():
    return F.concat("body", F.lit(" "), _pick(USES, F.col("id")))


def token_sql(patterns) -> str:
    return "lower(coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in patterns) + "))"


DETECTED_SQL = f"{USED_SQL}, k AS (SELECT *, {token_sql(rules.BUSES)} AS b, {token_sql(rules.PIPELINES)} AS p FROM u), d AS (SELECT *, CASE WHEN b IS NOT NULL THEN {cases('b', rules.BUS_NAMES, repr('EventBus'))} END AS bus, CASE WHEN p IS NOT NULL THEN {cases('p', rules.PIPELINE_NAMES, repr('ETL'))} END AS pipeline FROM k)"


@on_symbols("fun_18_detected", DETECTED_SQL + " SELECT id, bus, pipeline FROM d")
def _(s):
    return s.select("id", rules.detected(used(), rules.BUSES, rules.BUS_NAMES, "EventBus").alias("bus"), rules.detected(used(), rules.PIPELINES, rules.PIPELINE_NAMES, "ETL").alias("pipeline"))


@on_symbols("tag_04_message_edges", DETECTED_SQL + f" SELECT path || '::' || name AS from_key, 'EVENT_BUS::' || bus || '::' || path AS to_key, 'PUBLISHES_TO' AS relation FROM d WHERE bus IS NOT NULL AND regexp_matches(lower(t), '{rules.PUBLISHES}') UNION SELECT 'EVENT_BUS::' || bus || '::' || path, path || '::' || name, 'SUBSCRIBES_FROM' FROM d WHERE bus IS NOT NULL AND regexp_matches(lower(t), '{rules.SUBSCRIBES}') UNION SELECT path || '::' || name, 'DATA_PIPELINE::' || pipeline || '::' || name, 'CALLS' FROM d WHERE pipeline IS NOT NULL")
def _(s):
    return flw.message_edges(s, used())


@on_symbols("ext_10_databases", USED_SQL + " SELECT path, string_agg(DISTINCT name, ',' ORDER BY name) AS databases FROM (" + " UNION ALL ".join(f"SELECT path, '{n}' AS name FROM u WHERE regexp_matches(t, '{p}')" for p, n in rules.DATABASES) + ") GROUP BY path")
def _(s):
    found = s.select("path", F.explode(rules.databases(used())).alias("name"))
    return found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("databases"))


@query("fun_20_types", f"SELECT p_partkey, {cases('lower(f)', rules.SQL_TYPES, repr('VARCHAR(255)'))} AS sql_type, {cases('lower(f)', rules.PYTHON_TYPES, repr('str'))} AS python_type FROM (SELECT p_partkey, {_list(FIELDS)}[p_partkey % {len(FIELDS)} + 1] AS f FROM part)")
def _(spark, d):
    f = _pick(FIELDS, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", rules.type_of_name(f, rules.SQL_TYPES, "VARCHAR(255)").alias("sql_type"), rules.type_of_name(f, rules.PYTHON_TYPES, "str").alias("python_type"))


@query("fun_21_descriptions", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(m), '^({w})') THEN '{a}' || coalesce(nullif(trim(replace(substr(lower(m), {cut + 1}), '_', ' ')), ''), '{e}') || '{b}'" for w, cut, a, b, e in rules.METHOD_WORDS) + f" ELSE upper(substr(m, 1, 1)) || lower(substr(replace(m, '_', ' '), 2)) || '.' END AS says FROM (SELECT p_partkey, {_list(METHODS)}[p_partkey % {len(METHODS)} + 1] AS m FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.described(_pick(METHODS, F.col("p_partkey"))).alias("says"))


MENTIONS, DEFINES = r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE(?:\s+IF\s+NOT\s+EXISTS)?)\s+(\w+)", r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"


@on_symbols("rel_19_table_links", f", d AS (SELECT t, min(path) AS target FROM (SELECT path, unnest(regexp_extract_all(lower(body), '{DEFINES}', 1)) AS t FROM sym) GROUP BY t) SELECT DISTINCT path, target, t AS table_name FROM (SELECT path, unnest(regexp_extract_all(lower(body), '{MENTIONS}', 1)) AS t FROM sym) JOIN d USING (t) WHERE path <> target")
def _(s):
    return flw.table_links(s, MENTIONS, DEFINES)


FIRST_CHAINS = ROOT_CHAINS.replace("('CUSTOMER', 'SUPPLIER')", "('CUSTOMER')").replace("LIMIT 10", "LIMIT 5").replace("IN ('PLACES', 'SUPPLIES')", "IN ('PLACES')")


@on_graph("grf_18_sequence_steps", "SELECT seed, step - 1 AS number, source, CASE WHEN depth = 1 THEN 'places' ELSE 'holds' END AS verb, id AS target FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS step FROM r), LATERAL (SELECT min(e.from_id) AS source FROM e JOIN r u ON u.id = e.from_id WHERE e.to_id = k.id AND u.seed = k.seed AND u.depth = k.depth - 1) WHERE step BETWEEN 2 AND 13".replace("FROM r), LATERAL", "FROM r) k, LATERAL"), recursive=FIRST_CHAINS)
def _(g):
    places = rel.by_relation(g, "PLACES").select(F.col("from_id").alias("id"))
    first = flw.roots(g, ["CUSTOMER"]).join(places, "id", "left_semi").orderBy("id").limit(5)  # five entries, as in the reference
    return flw.sequence_steps(g, flw.seeds(first), {"PLACES": "places", "CONTAINS": "holds"})
