"""More queries: symbols, dependencies, classifiers, reports and caps, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import DEGREE, on_graph, query
from .functions import rules
from .functions import scalars as fn
from .operators import aggregates as agg
from .operators import symbols as sy
from .operators import windows as win
from .plans.graph import table
from .plans.symbols import SYMBOLS_SQL, dependencies, symbols


def on_symbols(name: str, sql: str):
    def put(f):
        query(name, f"WITH {SYMBOLS_SQL} {sql}")(lambda spark, d: f(symbols(spark, d)))
        return f

    return put


def on_dependencies(name: str, sql: str):
    def put(f):
        query(name, f"WITH {SYMBOLS_SQL} {sql}")(lambda spark, d: f(dependencies(spark, d)))
        return f

    return put


def cases(column: str, pairs, otherwise: str, test: str = "regexp_matches({}, '{}')") -> str:
    return "CASE " + " ".join(f"WHEN {test.format(column, k)} THEN '{v}'" for k, v in pairs) + f" ELSE {otherwise} END"


TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
PROMOTED = r"""CASE WHEN category = 'CLASS' THEN CASE WHEN regexp_matches(body, '(?i)@repository\b') THEN 'REPOSITORY' WHEN regexp_matches(body, '(?i)@(rest)?controller\b') THEN 'CONTROLLER' WHEN regexp_matches(body, '(?i)@(service|component|injectable|bean|configuration)\b') THEN 'SERVICE' WHEN regexp_matches(lower(body), 'extends') AND regexp_matches(lower(body), 'component') AND regexp_matches(name, '^[A-Z][a-zA-Z0-9]+$') THEN 'REACT_COMPONENT' ELSE 'CLASS' END
 WHEN category IN ('FUNCTION', 'ASYNC_DEF') THEN CASE WHEN regexp_matches(body, '(?i)\b(spark|sc|ss)\b.*\b(read|write|createDataFrame)\b') THEN 'SPARK_JOB' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]+$') AND regexp_matches(body, '(?i)return\s+<[A-Z]') THEN 'REACT_COMPONENT' WHEN category = 'ASYNC_DEF' THEN 'ASYNC_FUNCTION' ELSE 'FUNCTION' END
 WHEN category = 'HOOK' THEN 'REACT_HOOK' WHEN category IN ('METHOD', 'INTERFACE', 'IMPORT') THEN category END"""


# --- symbols ------------------------------------------------------------------------
@on_symbols("fil_07_promoted", f"SELECT id, t AS node_type FROM (SELECT id, {PROMOTED} AS t FROM sym) WHERE t IS NOT NULL")
def _(s):
    return s.select("id", rules.promoted(F.col("category"), F.col("name"), F.col("body")).alias("node_type")).where("node_type is not null")


@on_symbols("fil_08_tables", r"SELECT DISTINCT lower(t) AS table_name FROM (SELECT unnest(regexp_extract_all(body, '(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+(\w+)', 1)) AS t FROM sym) WHERE upper(t) <> 'IF' AND length(t) > 1")
def _(s):
    found = sy.found(s, r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+(\w+)", "t").where("upper(t) <> 'IF' and length(t) > 1")
    return found.select(F.lower("t").alias("table_name")).distinct()


@on_symbols("fil_14_skipped_prefixes", "SELECT id, name FROM sym WHERE NOT (starts_with(name, 'patch_') OR starts_with(name, 'fix_') OR starts_with(name, 'rewrite_') OR starts_with(name, 'refactor_') OR starts_with(name, 'test_') OR starts_with(name, 'get_old_') OR starts_with(name, 'final_patch_'))")
def _(s):
    return s.where(~F.col("name").rlike(rules.SKIPPED_PREFIXES)).select("id", "name")


@on_symbols("fil_29_artifact_labels", r"SELECT label, regexp_matches(label, '/[^/]*\.[^/]*$') OR regexp_matches(label, '\.(py|js|ts|java|go|yaml|json)$') OR starts_with(label, 'backend.') OR starts_with(label, 'src.') AS artifact FROM (SELECT DISTINCT name AS label FROM sym UNION SELECT path FROM sym)")
def _(s):
    labels = s.select(F.col("name").alias("label")).unionAll(s.select("path")).distinct()
    return labels.select("label", rules.artifact_label(F.col("label")).alias("artifact"))


@on_symbols("fil_30_calls", r"SELECT id, regexp_matches(name, '^use[A-Z]') AS hook, regexp_matches(body, '(?i)\b(axios|fetch|requests|http|HttpClient|get|post|put|patch|delete|request)\b') AS api_call, substr(string_split(split_part(body, '(', 1), '.')[-1], 1, 60) AS callee FROM sym")
def _(s):
    callee = F.substring(F.element_at(F.split(F.split_part("body", F.lit("("), F.lit(1)), r"\."), -1), 1, 60)
    return s.select("id", F.col("name").rlike("^use[A-Z]").alias("hook"), F.col("body").rlike(rules.API_WORDS).alias("api_call"), callee.alias("callee"))


MEMBERS = "SELECT m.path || '::' || m.parent, m.path || '::' || m.name, r FROM sym m JOIN sym c ON c.path = m.path AND c.name = m.parent AND c.category IN ('CLASS', 'INTERFACE'), (SELECT unnest(['CONTAINS', 'DEFINES']) AS r) WHERE m.category = 'METHOD'"


@on_symbols("rel_04_structure", f"SELECT path AS from_key, path || '::' || name AS to_key, 'CONTAINS' AS relation FROM sym WHERE category <> 'IMPORT' UNION SELECT path, path || '::' || name, 'DEFINES' FROM sym WHERE category IN ('CLASS', 'INTERFACE', 'FUNCTION', 'ASYNC_DEF') UNION {MEMBERS}")
def _(s):
    return sy.structure(s)


@on_dependencies("rel_05_imports", "SELECT DISTINCT source, target, 'IMPORTS' AS relation FROM dep WHERE dep_type = 'IMPORT' AND source <> target")
def _(d):
    return sy.file_edges(d, True)


@on_dependencies("rel_06_file_relations", "SELECT DISTINCT source, target, CASE dep_type WHEN 'API_CALL' THEN 'CALLS_API' WHEN 'FUNCTION_CALL' THEN 'CALLS' WHEN 'SQL_USE' THEN 'QUERIES_TABLE' WHEN 'CLASS_USE' THEN 'REFERENCES' ELSE 'DEPENDS_ON' END AS relation FROM dep WHERE dep_type <> 'IMPORT' AND source <> target")
def _(d):
    return sy.file_edges(d, False)


@on_symbols("rel_10_symbol_tables", r"SELECT DISTINCT path, name AS symbol, lower(t) AS table_name FROM (SELECT path, name, unnest(regexp_extract_all(body, '(?i)\b(?:FROM|JOIN)\s+(\w+)', 1)) AS t FROM sym)")
def _(s):
    return sy.found(s, r"(?i)\b(?:FROM|JOIN)\s+(\w+)", "t").select("path", "symbol", F.lower("t").alias("table_name")).distinct()


@on_symbols("rel_12_spark_frames", r"SELECT DISTINCT path, name, unnest(regexp_extract_all(body, '(\w+_df|\w+_data|df_\w+)\s*=', 1)) AS frame, CASE WHEN body LIKE '%.write.%(%' THEN 'WRITES_TO' ELSE 'READS_FROM' END AS relation FROM sym WHERE body LIKE '%spark.read.%(%' OR body LIKE '%.write.%(%'")
def _(s):
    return sy.spark_frames(s)


@on_symbols("rel_13_routes", r"SELECT DISTINCT path, name AS symbol, unnest(regexp_extract_all(body, '@app\.get\(''([^'']+)''', 1)) AS route FROM sym")
def _(s):
    return sy.found(s, rules.ROUTE, "route")


@on_symbols("rel_15_annotations", "SELECT DISTINCT path, name AS symbol, unnest(regexp_extract_all(body, '@(Service|Repository|RestController)', 1)) AS annotation FROM sym")
def _(s):
    return sy.found(s, rules.ANNOTATION, "annotation")


@on_symbols("rel_20_canonical_files", "SELECT canonical, count(DISTINCT path) AS files FROM (SELECT path, lower(name) AS canonical FROM sym WHERE category IN ('FUNCTION', 'METHOD', 'ASYNC_DEF')) GROUP BY canonical HAVING count(DISTINCT path) > 1")
def _(s):
    names = s.where(F.col("category").isin("FUNCTION", "METHOD", "ASYNC_DEF")).select("path", fn.canonical(F.col("name")).alias("canonical")).distinct()
    return names.groupBy("canonical").agg(F.count("*").alias("files")).where("files > 1")


@on_dependencies("rel_21_links", "SELECT DISTINCT source, target, dep_type, symbol FROM dep WHERE source <> target")
def _(d):
    return d.where("source <> target").dropDuplicates(["source", "target", "dep_type", "symbol"])


@on_dependencies("rel_27_last_component", "SELECT source AS node, max(target) AS component FROM dep WHERE CAST(regexp_extract(source, '[0-9]+') AS INT) % 10 = CAST(regexp_extract(target, '[0-9]+') AS INT) % 10 GROUP BY source")
def _(d):
    last = lambda c: F.pmod(F.regexp_extract(c, "[0-9]+", 0).cast("int"), F.lit(10))
    pairs = d.where(last("source") == last("target"))
    return pairs.groupBy(F.col("source").alias("node")).agg(F.max_by("target", "target").alias("component"))


@on_dependencies("rel_35_first_capability", "SELECT source AS component, min(symbol) AS capability FROM dep GROUP BY source")
def _(d):
    return d.groupBy(F.col("source").alias("component")).agg(F.min("symbol").alias("capability"))


@on_dependencies("rel_36_lifted", "SELECT DISTINCT a.c AS source, b.c AS target, dep_type FROM dep JOIN (SELECT source AS f, min(symbol) AS c FROM dep GROUP BY 1) a ON dep.source = a.f JOIN (SELECT source AS f, min(symbol) AS c FROM dep GROUP BY 1) b ON dep.target = b.f WHERE a.c <> b.c")
def _(d):
    of = d.groupBy(F.col("source").alias("f")).agg(F.min("symbol").alias("c"))
    lifted = d.join(of.select(F.col("f").alias("source"), F.col("c").alias("from_c")), "source").join(of.select(F.col("f").alias("target"), F.col("c").alias("to_c")), "target")
    return lifted.where("from_c <> to_c").select(F.col("from_c").alias("source"), F.col("to_c").alias("target"), "dep_type").distinct()


@on_dependencies("rel_47_known", "SELECT source, count(*) AS known FROM (SELECT DISTINCT source, target FROM dep) WHERE target IN (SELECT source FROM dep WHERE dep_type = 'IMPORT') AND source <> target GROUP BY source")
def _(d):
    lists = d.groupBy("source").agg(F.collect_set("target").alias("targets"))
    known = d.where("dep_type = 'IMPORT'").select(F.col("source").alias("target")).distinct()
    return lists.select("source", F.explode("targets").alias("target")).where("source <> target").join(known, "target", "left_semi").groupBy("source").agg(F.count("*").alias("known"))


# --- edges of the order graph ---------------------------------------------------------
@on_graph("rel_29_handlers", "SELECT n.id, max(from_id) FILTER (relation = 'SUPPLIES') AS handler, max(from_id) FILTER (relation = 'CONTAINS') AS file FROM g_nodes n LEFT JOIN g_edges ON to_id = n.id WHERE node_type = 'PART' GROUP BY n.id")
def _(g):
    last = lambda r: F.max(F.when(F.col("relation") == r, F.col("from_id")))
    into = g.edges.groupBy(F.col("to_id").alias("id")).agg(last("SUPPLIES").alias("handler"), last("CONTAINS").alias("file"))
    return g.nodes.where("node_type = 'PART'").select("id").join(into, "id", "left")


@on_graph("rel_44_linked", "SELECT id, n AS neighbour FROM (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM (SELECT from_id AS id, to_id AS n FROM g_edges WHERE from_id LIKE 'nation%' UNION SELECT to_id, from_id FROM g_edges WHERE to_id LIKE 'nation%')) WHERE k <= 15")
def _(g):
    ends = F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("neighbour")), F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("neighbour")))).alias("e")
    both = g.edges.select(ends).select("e.*").where("id like 'nation%'").distinct()
    return win.top_per_group(both, ["id"], [F.col("neighbour")], 15).select("id", "neighbour")


@on_graph("agg_02_report", "SELECT count(*) AS nodes, round(avg(i + o), 4) AS avg_degree, max(i + o) AS max_degree, max(id) FILTER (i + o = (SELECT max(i + o) FROM deg)) AS last_at_max, count(*) FILTER (i + o = 0) AS lone FROM deg", recursive=DEGREE)
def _(g):
    d = agg.degrees(g).select("id", (F.col("in_degree") + F.col("out_degree")).alias("d"))
    return d.agg(F.count("*").alias("nodes"), F.round(F.avg("d"), 4).alias("avg_degree"), F.max("d").alias("max_degree"), F.max_by("id", F.struct("d", "id")).alias("last_at_max"), F.count_if(F.col("d") == 0).alias("lone"))


@on_graph("agg_11_manifest", "SELECT 'service' AS strategy, (SELECT count(*) FROM g_nodes) AS total_nodes, (SELECT count(*) FROM g_edges) AS total_edges, (SELECT count(DISTINCT coalesce(service, '__default__')) FROM g_nodes) AS partitions, (SELECT count(*) FROM g_edges JOIN g_nodes a ON from_id = a.id JOIN g_nodes b ON to_id = b.id WHERE coalesce(a.service, '') <> coalesce(b.service, '')) AS cross_edges")
def _(g):
    p = agg.partitions(g).agg(F.sum("nodes").alias("total_nodes"), F.count("*").alias("partitions"), F.sum("cross_edges").alias("cross_edges"), F.sum(F.col("edges") + F.col("cross_edges")).alias("total_edges"))
    return p.select(F.lit("service").alias("strategy"), "total_nodes", "total_edges", "partitions", "cross_edges")


@on_graph("agg_17_ownership", "SELECT to_id AS id, max(from_id) AS owner FROM g_edges WHERE relation = 'SUPPLIES' GROUP BY to_id")
def _(g):
    return g.edges.where("relation = 'SUPPLIES'").groupBy(F.col("to_id").alias("id")).agg(F.max("from_id").alias("owner"))


@on_graph("agg_18_capabilities", "SELECT domain, count(*) AS members, count(DISTINCT node_type) AS kinds FROM g_nodes WHERE node_type IN ('CUSTOMER', 'PART') AND domain IS NOT NULL GROUP BY domain")
def _(g):
    n = g.nodes.where(F.col("node_type").isin("CUSTOMER", "PART") & F.col("domain").isNotNull())
    return n.groupBy("domain").agg(F.count("*").alias("members"), F.count_distinct("node_type").alias("kinds"))


@on_graph("agg_41_cluster_confidence", "SELECT id, CASE WHEN i + o >= 10 THEN 'high' WHEN i + o >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM deg", recursive=DEGREE)
def _(g):
    n = F.col("in_degree") + F.col("out_degree")
    return agg.degrees(g).select("id", F.when(n >= 10, "high").when(n >= 3, "medium").otherwise("low").alias("confidence"))


@on_dependencies("agg_44_dependency_stats", "SELECT 'type' AS what, dep_type AS value, count(*) AS n FROM dep GROUP BY dep_type UNION ALL SELECT 'source', 'files', count(DISTINCT source) FROM dep")
def _(d):
    return d.groupBy(F.lit("type").alias("what"), F.col("dep_type").alias("value")).agg(F.count("*").alias("n")).unionByName(d.agg(F.count_distinct("source").alias("n")).select(F.lit("source").alias("what"), F.lit("files").alias("value"), "n"))


@query("agg_14_routes", "SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS route, max(page_id) AS last_page FROM pages GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(F.regexp_replace(fn.url_path(F.col("url")), "[?#].*$", "").alias("route")).agg(F.max("page_id").alias("last_page"))


@on_symbols("agg_31_api_surface", f"SELECT method, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(x, 'create|register|add|post') THEN 'POST' WHEN regexp_matches(x, 'update|edit|put|modify') THEN 'PUT' WHEN regexp_matches(x, 'delete|remove') THEN 'DELETE' WHEN regexp_matches(x, 'patch') THEN 'PATCH' ELSE 'GET' END AS method FROM (SELECT lower(name) AS x FROM sym)) GROUP BY method")
def _(s):
    return s.groupBy(fn.http_method(F.col("name")).alias("method")).agg(F.count("*").alias("n"))


@query("agg_35_batches", "SELECT user_id, count(*) FILTER (value >= 100) AS completed, count(*) FILTER (value >= 50 AND value < 100) AS partial, count(*) FILTER (value < 50) AS failed FROM events GROUP BY user_id")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(v >= 100).alias("completed"), F.count_if((v >= 50) & (v < 100)).alias("partial"), F.count_if(v < 50).alias("failed"))


@query("agg_42_primary", "SELECT user_id, event_type AS pattern FROM (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE k = 1 AND share >= 0.2")
def _(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = n.groupBy("user_id").agg(F.min_by(F.struct("event_type", "n"), F.struct(-F.col("n"), "event_type")).alias("top"), F.sum("n").alias("total"))
    return top.where(F.col("top.n") / F.col("total") >= 0.2).select("user_id", F.col("top.event_type").alias("pattern"))


@query("agg_45_results", "SELECT event_type || ':' || user_id AS label, count(*) FILTER (value >= 50) AS succeeded, count(*) FILTER (value < 50) AS failed FROM events GROUP BY 1")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.concat_ws(":", "event_type", "user_id").alias("label")).agg(F.count_if(v >= 50).alias("succeeded"), F.count_if(v < 50).alias("failed"))


# --- orders and caps --------------------------------------------------------------------
@query("win_09_percent", "SELECT source, lang, n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 4) AS percent FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)")
def _(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4))


@on_graph("top_02_central", "SELECT id, i + o AS degree FROM deg ORDER BY i + o DESC, id LIMIT 200", recursive=DEGREE)
def _(g):
    return agg.degrees(g).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).orderBy(F.desc("degree"), "id").limit(200)


@on_graph("top_03_ir_caps", "SELECT relation, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY weight DESC, from_id, to_id) AS k FROM g_edges) WHERE k <= 20")
def _(g):
    return win.top_per_group(g.edges, ["relation"], [F.desc("weight"), F.col("from_id"), F.col("to_id")], 20).select("relation", "from_id", "to_id")


@on_graph("top_04_blueprint_caps", "SELECT node_type, id FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY name, id) AS k FROM g_nodes) WHERE k <= CASE node_type WHEN 'REGION' THEN 7 WHEN 'NATION' THEN 5 WHEN 'CUSTOMER' THEN 8 ELSE 10 END")
def _(g):
    cap = F.when(F.col("node_type") == "REGION", 7).when(F.col("node_type") == "NATION", 5).when(F.col("node_type") == "CUSTOMER", 8).otherwise(10)
    return win.top_per_group(g.nodes, ["node_type"], [F.col("name"), F.col("id")], 10).where(F.col("rank") <= cap).select("node_type", "id")


@on_dependencies("top_05_dependency_notes", "SELECT source, array_to_string(l[1:5], ',') || CASE WHEN len(l) > 5 THEN ' (+' || (len(l) - 5) || ' more)' ELSE '' END AS note FROM (SELECT source, list_sort(list(DISTINCT target)) AS l FROM dep GROUP BY source)")
def _(d):
    n = d.select("source", "target").distinct().withColumn("n", F.count("*").over(Window.partitionBy("source")))
    top = win.top_per_group(n, ["source"], [F.col("target")], 5).groupBy("source").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("target")).alias("l"))
    return top.select("source", F.concat(F.array_join("l", ","), F.when(F.col("n") > 5, F.concat(F.lit(" (+"), F.col("n") - 5, F.lit(" more)"))).otherwise("")).alias("note"))


@on_graph("top_06_model_caps", "SELECT domain, id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS k FROM g_nodes WHERE domain IS NOT NULL AND node_type = 'CUSTOMER') WHERE k <= 4")
def _(g):
    return win.top_per_group(g.nodes.where("domain is not null and node_type = 'CUSTOMER'"), ["domain"], [F.col("id")], 4).select("domain", "id")


RANKS = "CASE node_type WHEN 'REGION' THEN 0 WHEN 'NATION' THEN 1 WHEN 'CUSTOMER' THEN 2 WHEN 'SUPPLIER' THEN 3 WHEN 'PART' THEN 4 ELSE 5 END"


@on_graph("top_08_xml_order", f"SELECT id, row_number() OVER (ORDER BY {RANKS}, node_type, name, id) AS place FROM g_nodes")
def _(g):
    ranked = g.nodes.withColumn("type_rank", F.expr(RANKS))
    return win.global_row_number(ranked, ["type_rank", "node_type", "name", "id"]).select("id", F.col("rn").alias("place"))


@query("set_06_domains", "SELECT c_mktsegment AS domain FROM customer UNION SELECT p_type FROM part")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("domain")).unionAll(table(spark, d, "part").select("p_type")).distinct()


# --- functions ----------------------------------------------------------------------------
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9_]', '_', 'g'), '_')"


@on_symbols("fun_02_node_ids", f"SELECT id, concat_ws('__', CASE category WHEN 'FUNCTION' THEN 'func' WHEN 'METHOD' THEN 'meth' WHEN 'CLASS' THEN 'cls' WHEN 'INTERFACE' THEN 'iface' WHEN 'SQL_QUERY' THEN 'qry' WHEN 'IMPORT' THEN 'imp' ELSE 'node' END, nullif({SLUG.format('name')}, ''), nullif({SLUG.format('path')}, '')) AS node_id FROM sym")
def _(s):
    return s.select("id", rules.node_id(F.col("category"), F.col("name"), F.col("path")).alias("node_id"))


@on_symbols("fun_05_import_specs", "SELECT id, CASE name WHEN 'from app.models import Order' THEN 'app/models' WHEN 'import java.util.List;' THEN 'java/util/List' WHEN 'import { Chart } from ''./Chart''' THEN './Chart' WHEN 'import helpers' THEN 'helpers' END AS spec FROM sym WHERE category = 'IMPORT'")
def _(s):
    return s.where("category = 'IMPORT'").select("id", rules.import_spec(F.col("name")).alias("spec"))


KIND = "CASE WHEN regexp_matches(body, '^(CREATE|DROP|ALTER|TRUNCATE) ') THEN 'SQL_DDL' WHEN regexp_matches(body, '^(INSERT|UPDATE|DELETE|MERGE) ') THEN 'SQL_DML' WHEN regexp_matches(body, '^(SELECT|WITH) ') THEN 'SQL_QUERY' END"


@on_symbols("fun_07_sql_category", f"SELECT id, {KIND} AS category FROM sym")
def _(s):
    return s.select("id", rules.sql_category(F.col("body")).alias("category"))


@on_symbols("fun_08_sql_names", f"SELECT id, CASE {KIND} WHEN 'SQL_DDL' THEN 'ledger' WHEN 'SQL_DML' THEN 'insert_audit' WHEN 'SQL_QUERY' THEN 'query_orders' ELSE 'stmt_' || id END AS label FROM sym")
def _(s):
    return s.select("id", rules.sql_name(F.col("body"), F.col("id")).alias("label"))


@on_symbols("fun_13_steps", f"SELECT id, {TITLE.format('replace(name, ' + repr('_') + ', ' + repr(' ') + ')')} AS step FROM sym WHERE category = 'FUNCTION'")
def _(s):
    return s.where("category = 'FUNCTION'").select("id", rules.step_name(F.col("name")).alias("step"))


FLOW_CASES = " ".join(f"WHEN regexp_matches(lower(x), '{p}') THEN '{n} Flow'" for p, n in rules.FLOWS.items())


@query("fun_14_flows", f"SELECT page_id, CASE {FLOW_CASES} WHEN trim(regexp_replace(trim(x, '/'), '[/_]', ' ', 'g')) <> '' THEN {TITLE.format('trim(regexp_replace(trim(x, ' + repr('/') + '), ' + repr('[/_]') + ', ' + repr(' ') + ', ' + repr('g') + '))')} || ' Flow' ELSE 'Unknown Flow' END AS flow FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS x FROM pages)")
def _(spark, d):
    path = F.regexp_replace(fn.url_path(F.col("url")), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", rules.flow_name(path).alias("flow"))


@on_symbols("fun_16_layers", "SELECT id, " + cases("lower(x)", [(w.replace(" ", "|"), k) for k, w in rules.COMPONENT_LAYERS.items()], "'Application'") + " AS component, " + cases("lower(x)", [(w, k) for k, w in rules.CAPABILITY_LAYERS.items()], "'Application'") + " AS capability FROM (SELECT id, name || ' ' || body AS x FROM sym)")
def _(s):
    x = F.concat_ws(" ", "name", "body")
    return s.select("id", rules.component_layer(x).alias("component"), rules.capability_layer(x).alias("capability"))


@on_symbols("fun_17_lifecycle_tiers", f"SELECT id, CASE WHEN t = 'CONTROLLER' THEN 'Controller' WHEN t = 'SERVICE' THEN 'Service' WHEN t = 'REPOSITORY' THEN 'Repository' WHEN t IN ('FUNCTION', 'ASYNC_FUNCTION', 'METHOD') THEN 'Function' WHEN t = 'CLASS' THEN 'Component' ELSE 'Other' END AS tier FROM (SELECT id, {PROMOTED} AS t FROM sym)")
def _(s):
    return s.select("id", rules.lifecycle_tier(rules.promoted(F.col("category"), F.col("name"), F.col("body"))).alias("tier"))


@on_symbols("fun_19_frameworks", "SELECT id, CASE WHEN body LIKE '%from fastapi%' OR body LIKE '%import fastapi%' THEN 'fastapi' WHEN body LIKE '%from flask%' OR body LIKE '%import flask%' THEN 'flask' WHEN body LIKE '%from django%' THEN 'django' WHEN body LIKE '%@Controller%' AND body LIKE '%@Get%' THEN 'nestjs' WHEN body LIKE '%@RestController%' OR body LIKE '%@RequestMapping%' THEN 'spring' ELSE '' END AS framework FROM sym")
def _(s):
    return s.select("id", rules.framework(F.col("body")).alias("framework"))


@on_symbols("fun_22_roles", "SELECT id, CASE " + " ".join(f"WHEN contains(lower(name), '{k}') THEN '{v}'" for k, v in rules.ROLES.items()) + " ELSE 'general_processing' END AS role FROM sym")
def _(s):
    return s.select("id", rules.semantic_role(F.col("name")).alias("role"))


@on_symbols("fun_23_sensitivity", f"SELECT id, CASE WHEN regexp_matches(lower(x), '{rules.RESTRICTED}') THEN 'Restricted' WHEN regexp_matches(lower(x), '{rules.CONFIDENTIAL}') THEN 'Confidential' ELSE 'Internal' END AS sensitivity FROM (SELECT id, name || ['_plain', '_token', '_account', '_master_key'][id % 4 + 1] AS x FROM sym)")
def _(s):
    x = F.concat("name", F.element_at(F.array(*map(F.lit, ("_plain", "_token", "_account", "_master_key"))), (F.col("id") % 4 + 1).cast("int")))
    return s.select("id", rules.data_sensitivity(x).alias("sensitivity"))


@on_symbols("fun_24_business_names", f"SELECT id, regexp_replace({TITLE.format('replace(name, ' + repr('_') + ', ' + repr(' ') + ')')}, ' Model$', '') AS label FROM sym WHERE category = 'FUNCTION'")
def _(s):
    return s.where("category = 'FUNCTION'").select("id", rules.business_name(F.concat("name", F.when(F.col("id") % 2 == 0, "_model").otherwise("Schema"))).alias("label"))


@query("fun_28_json_tokens", r"SELECT event_id, CAST(floor(len(regexp_extract_all(x, '[^ \t\n\r\f\v]+')) * 1.3) + floor(len(regexp_extract_all(x, '[{}\[\]()=<>:;,./\\|@#$%^&*~`]')) * 0.3) AS BIGINT) AS tokens FROM (SELECT event_id, '{" + '"event_type": "' + r"' || event_type || '" + '", "user_id": ' + r"' || user_id || '}' AS x FROM events)")
def _(spark, d):
    x = F.format_string('{"event_type": "%s", "user_id": %s}', "event_type", F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", fn.estimate_tokens(x).cast("long").alias("tokens"))


@query("fun_35_transitions", "SELECT DISTINCT a, b, CASE WHEN regexp_matches(b, 'order|request|booking') THEN 'Creates' WHEN regexp_matches(b, 'payment|transaction') THEN 'Triggers' WHEN regexp_matches(b, 'record|log|history') THEN 'Recorded in' WHEN regexp_matches(a, 'cart|basket') THEN 'Submitted as' ELSE 'Flows to' END AS verb FROM (SELECT ['cart', 'account', 'basket'][event_id % 3 + 1] || ' ' || event_type AS a, ['order', 'payment', 'log', 'ledger'][user_id % 4 + 1] || ' of ' || event_type AS b FROM events)")
def _(spark, d):
    of = lambda words, c: F.element_at(F.array(*map(F.lit, words)), (F.col(c) % len(words) + 1).cast("int"))
    e = table(spark, d, "events").select(F.concat_ws(" ", of(("cart", "account", "basket"), "event_id"), "event_type").alias("a"), F.concat(of(("order", "payment", "log", "ledger"), "user_id"), F.lit(" of "), "event_type").alias("b")).distinct()
    return e.select("a", "b", rules.transition(F.col("a"), F.col("b")).alias("verb"))


@query("fil_12_endpoints", "SELECT page_id, x AS endpoint FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS x FROM pages) WHERE length(x) > 1 AND NOT regexp_matches(lower(x), '/path|/test|/example|/placeholder|/foo|/bar|/mock|/sample')")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace(fn.url_path(F.col("url")), "[?#].*$", "").alias("endpoint"))
    return p.where(F.length("endpoint") > 1).where(~F.lower("endpoint").rlike(rules.PLACEHOLDERS))


@on_graph("fil_28_facades", "SELECT 'member' AS kind, id FROM (SELECT id FROM g_nodes WHERE service = 'ASIA' ORDER BY id LIMIT 50) UNION ALL SELECT 'in', from_id FROM g_edges WHERE to_id = 'nation__1' UNION ALL SELECT 'out', to_id FROM g_edges WHERE from_id = 'nation__1'")
def _(g):
    member = g.nodes.where("service = 'ASIA'").orderBy("id").limit(50).select(F.lit("member").alias("kind"), "id")
    return member.unionAll(g.edges.where("to_id = 'nation__1'").select(F.lit("in"), "from_id")).unionAll(g.edges.where("from_id = 'nation__1'").select(F.lit("out"), "to_id"))
