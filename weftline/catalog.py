"""Queries of the reference-level operators on the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalars as fn
from .operators import aggregates as agg
from .operators import graphs as grf
from .operators import relational as rel
from .operators import retrieval as ctx
from .operators import windows as win
from .plans.graph import GRAPH_SQL, Graph, order_graph, table
from .sources import files as src
from .streaming import events as stream

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
TAGS = {"animals": ["tion", "ment"], "places": ["heit", "keit"], "things": ["ción"], "verbs": ["ing"]}


def query(name: str, sql: str | None = None, graph: bool = False, recursive: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH_SQL}{', ' + recursive if recursive else ''} {sql}" if graph else sql).strip()
        return f

    return put


def on_graph(name: str, sql: str | None = None, recursive: str | None = None):
    """A query whose function takes the graph."""

    def put(f):
        query(name, sql, graph=True, recursive=recursive)(lambda spark, d: f(order_graph(spark, d)))
        return f

    return put


def parties(g: Graph) -> Graph:
    """Regions, nations, customers and suppliers with what lies between them."""
    return rel.induced(g, g.nodes.where(F.col("node_type").isin("REGION", "NATION", "CUSTOMER", "SUPPLIER")))


# --- filters --------------------------------------------------------------------
@on_graph("fil_01_by_type", "SELECT id, name FROM g_nodes WHERE node_type = 'SUPPLIER'")
def _(g):
    return rel.by_type(g, "SUPPLIER").select("id", "name")


@on_graph("fil_02_by_relation", "SELECT from_id, to_id, CAST(weight AS BIGINT) AS weight FROM g_edges WHERE relation = 'SUPPLIES'")
def _(g):
    return rel.by_relation(g, "SUPPLIES").select("from_id", "to_id", "weight")


@on_graph("fil_03_properties", "SELECT id, nullif(trim(substr(name, 1, 8)), '') AS name, nullif(trim(coalesce(domain, '')), '') AS domain FROM g_nodes WHERE node_type = 'PART'")
def _(g):
    n = rel.by_type(g, "PART")
    return n.select("id", rel.blank_to_null(F.col("name"), 8).alias("name"), rel.blank_to_null(F.coalesce("domain", F.lit(""))).alias("domain"))


@on_graph("fil_04_find", "SELECT id, name FROM g_nodes WHERE contains(lower(name), 'widget') AND node_type = 'PART' ORDER BY id LIMIT 1")
def _(g):
    return rel.find_node(g, "Widget", "PART").select("id", "name")


@on_graph("fil_05_cluster", "SELECT id, node_type FROM g_nodes WHERE contains(lower(service), 'asia') AND contains(lower(domain), 'auto')")
def _(g):
    return rel.cluster(g, "asia", "auto").select("id", "node_type")


@query("fil_09_exclusion", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/(en|fr)/') AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = page_id AND lang = 'de')")
def _(spark, d):
    mock = table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("page_id"))
    return table(spark, d, "pages").where(~F.col("url").rlike("/(en|fr)/")).join(mock, "page_id", "left_anti").select("page_id", "url")


@query("fil_10_valid_step", "SELECT conv_id, turn FROM conversations WHERE length(text) >= 3 AND NOT starts_with(text, '_') AND NOT contains(text, '/') AND NOT regexp_matches(text, '\\.(py|js|ts|java)')")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").where((F.length(t) >= 3) & ~t.startswith("_") & ~F.contains(t, F.lit("/")) & ~t.rlike(r"\.(py|js|ts|java)")).select("conv_id", "turn")


@query("fil_11_valid_endpoint", "SELECT page_id, p AS path FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', '') AS p FROM pages) WHERE starts_with(p, '/') AND length(p) >= 2 AND NOT regexp_matches(p, 'placeholder|example')")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", fn.route(fn.url_path(F.col("url"))).alias("path"))
    return p.where(F.col("path").startswith("/") & (F.length("path") >= 2) & ~F.col("path").rlike("placeholder|example"))


@query("fil_13_keywords", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) WHERE w NOT IN (" + ", ".join(f"'{w}'" for w in fn.STOP_WORDS) + ") GROUP BY w")
def _(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("w"))
    return w.where(~F.col("w").isin(*fn.STOP_WORDS)).groupBy("w").agg(F.count("*").alias("n"))


@query("fil_15_stub_flows", "SELECT conv_id FROM (SELECT conv_id, count(*) AS n, bool_and(text = upper(text)) AS up FROM conversations GROUP BY conv_id) WHERE n < 4 OR up")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(F.col("text") == F.upper("text")).alias("up")).where("n < 4 or up").select("conv_id")


@query("fil_21_scrub", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[#*$%&|]+', '', 'g'), ' +', ' ', 'g')) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace(F.regexp_replace("text", "[#*$%&|]+", ""), " +", " ").cast("binary")).alias("h"))


@query("fil_23_gate", "SELECT round(least(1.0, sum(CASE WHEN regexp_matches(lower(text), 'token|secret') THEN 1 ELSE 0 END) / greatest(0.05 * count(*), 1)), 6) AS score FROM documents")
def _(spark, d):
    hit = F.lower("text").rlike("token|secret")
    return table(spark, d, "documents").agg(F.round(F.least(F.lit(1.0), F.count_if(hit) / F.greatest(F.lit(0.05) * F.count("*"), F.lit(1.0))), 6).alias("score"))


@on_graph("fil_24_loss_gate", "SELECT (SELECT count(*) FROM g_nodes WHERE domain IS NOT NULL) * 2 >= (SELECT count(*) FROM g_nodes) AS ok")
def _(g):
    return g.nodes.agg((F.count("domain") * 2 >= F.count("*")).alias("ok"))


# --- joins ------------------------------------------------------------------------
@on_graph("rel_01_integrity", "SELECT relation, count(*) AS n FROM g_edges GROUP BY relation")
def _(g):
    dirty = g.edges.unionByName(g.edges.where("relation = 'BELONGS_TO'").withColumn("to_id", F.col("from_id")))
    dirty = dirty.unionByName(g.edges.where("relation = 'BELONGS_TO'").withColumn("to_id", F.lit("nowhere__1"))).unionByName(g.edges.where("relation = 'PLACES'"))
    return rel.with_integrity(g.nodes, dirty).groupBy("relation").agg(F.count("*").alias("n"))


@on_graph("rel_02_enriched", "SELECT from_id, to_id, relation, a.name AS from_name, b.name AS to_name, b.node_type AS to_node_type FROM g_edges JOIN g_nodes a ON from_id = a.id JOIN g_nodes b ON to_id = b.id")
def _(g):
    return rel.enriched(g).select("from_id", "to_id", "relation", "from_name", "to_name", "to_node_type")


@on_graph("rel_03_neighbours", "SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM g_edges UNION ALL SELECT to_id FROM g_edges) GROUP BY id")
def _(g):
    return rel.neighbours(g).groupBy("id").agg(F.count("*").alias("n"))


@query(
    "rel_14_as_of",
    "SELECT e.event_id AS left_id, n.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN LATERAL (SELECT event_id FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts > e.ts ORDER BY p.ts, p.event_id LIMIT 1) n ON true",
)
def _(spark, d):
    e = table(spark, d, "events")
    return rel.as_of_next(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id").select("left_id", "next_id")


PATHS = "SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', '') AS call FROM pages"


@query(
    "rel_22_route_match",
    f"WITH c AS ({PATHS}), r AS (SELECT DISTINCT '/' || split_part(call, '/', 2) AS route FROM c) SELECT call, route FROM (SELECT call, route, row_number() OVER (PARTITION BY call ORDER BY length(route) DESC) AS k FROM c JOIN r ON call = route OR starts_with(call, route || '/')) WHERE k = 1",
)
def _(spark, d):
    calls = table(spark, d, "pages").select(fn.route(fn.url_path(F.col("url"))).alias("call")).distinct()
    routes = calls.select(F.concat(F.lit("/"), F.get(F.split("call", "/"), F.lit(1))).alias("route")).distinct()
    return rel.match_routes(calls, routes).select("call", "route")


CROSS = "SELECT a.service AS source, b.service AS target, relation, count(*) AS n FROM g_edges JOIN g_nodes a ON from_id = a.id JOIN g_nodes b ON to_id = b.id WHERE a.service <> b.service GROUP BY ALL"


@on_graph("rel_23_service_map", CROSS)
def _(g):
    return rel.cross_counts(g)


@on_graph(
    "rel_23_trade_map",
    "SELECT s.service AS source, c.service AS target, count(*) AS n FROM g_edges x JOIN g_edges y ON x.to_id = y.to_id AND x.relation = 'SUPPLIES' AND y.relation = 'CONTAINS' JOIN g_nodes s ON x.from_id = s.id JOIN g_nodes c ON y.from_id = c.id GROUP BY ALL",
)
def _(g):
    """Regions that supply parts that orders of a region contain; both sides are counted by part first, so no part's suppliers and orders are paired out."""
    service = g.nodes.select("id", "service")
    a = rel.by_relation(g, "SUPPLIES").join(service.withColumnRenamed("id", "from_id"), "from_id").groupBy("to_id", F.col("service").alias("source")).agg(F.count("*").alias("x"))
    b = rel.by_relation(g, "CONTAINS").join(service.withColumnRenamed("id", "from_id"), "from_id").groupBy("to_id", F.col("service").alias("target")).agg(F.count("*").alias("y"))
    return a.join(b, "to_id").groupBy("source", "target").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


@on_graph("rel_25_induced", "SELECT relation, count(*) AS n FROM g_edges WHERE from_id IN (SELECT id FROM g_nodes WHERE service = 'EUROPE') AND to_id IN (SELECT id FROM g_nodes WHERE service = 'EUROPE') GROUP BY relation")
def _(g):
    return rel.induced(g, rel.cluster(g, service="europe")).edges.groupBy("relation").agg(F.count("*").alias("n"))


@query("rel_26_pipelines", "SELECT l_suppkey AS source, o_custkey AS sink, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("source"), F.col("o_custkey").alias("sink")).agg(F.count("*").alias("n"))


@on_graph("rel_28_confidence", f"SELECT source, target, n, CASE WHEN n >= 3 THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT x.node_type AS source, y.node_type AS target, count(*) AS n FROM g_edges JOIN g_nodes x ON from_id = x.id JOIN g_nodes y ON to_id = y.id GROUP BY ALL)")
def _(g):
    return rel.enriched(g, ("node_type",)).groupBy(F.col("from_node_type").alias("source"), F.col("to_node_type").alias("target")).agg(F.count("*").alias("n")).withColumn("confidence", agg.confidence(F.col("n")))


@on_graph("rel_30_accessors", "SELECT to_id AS id, string_agg(DISTINCT relation, ',' ORDER BY relation) AS operations, count(DISTINCT from_id) AS accessors FROM g_edges WHERE starts_with(to_id, 'part__') GROUP BY to_id")
def _(g):
    e = g.edges.where(F.col("to_id").startswith("part__"))
    return e.groupBy(F.col("to_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("operations"), F.countDistinct("from_id").alias("accessors"))


@query("rel_31_merge", "SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return rel.merged(table(spark, d, "labels").select("doc_id", F.lit("label").alias("origin")), table(spark, d, "documents").select("doc_id", F.lit("document").alias("origin")), ["doc_id"])


@on_graph("rel_32_orphans", "SELECT id, node_type FROM g_nodes WHERE id NOT IN (SELECT from_id FROM g_edges UNION SELECT to_id FROM g_edges)")
def _(g):
    return rel.orphans(g).select("id", "node_type")


@query("rel_40_three_hops", "SELECT DISTINCT c_mktsegment AS segment, p_brand AS brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    x = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(F.col("c_mktsegment").alias("segment"), F.col("p_brand").alias("brand")).distinct()


@on_graph("rel_45_service_stores", "SELECT a.service, count(DISTINCT to_id) AS stores FROM g_edges JOIN g_nodes a ON from_id = a.id WHERE relation IN ('CONTAINS', 'SUPPLIES') GROUP BY a.service")
def _(g):
    e = rel.enriched(g, ("service",)).where(F.col("relation").isin("CONTAINS", "SUPPLIES"))
    return e.select(F.col("from_service").alias("service"), "to_id").distinct().groupBy("service").agg(F.count("*").alias("stores"))


# --- aggregates ---------------------------------------------------------------------
@on_graph("agg_01_stats", "SELECT 'nodes' AS what, count(*) AS n FROM g_nodes UNION ALL SELECT 'edges', count(*) FROM g_edges UNION ALL SELECT node_type, count(*) FROM g_nodes GROUP BY 1 UNION ALL SELECT relation, count(*) FROM g_edges GROUP BY 1")
def _(g):
    parts = [g.nodes.select(F.lit("nodes")), g.edges.select(F.lit("edges")), g.nodes.select("node_type"), g.edges.select("relation")]
    out = [p.toDF("what").groupBy("what").agg(F.count("*").alias("n")) for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@on_graph("agg_03_distribution", "SELECT node_type AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM g_nodes GROUP BY node_type")
def _(g):
    return agg.distribution(g.nodes, "node_type")


DEGREE = "deg AS (SELECT id, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM g_nodes LEFT JOIN (SELECT to_id, count(*) AS i FROM g_edges GROUP BY 1) ON to_id = id LEFT JOIN (SELECT from_id, count(*) AS o FROM g_edges GROUP BY 1) ON from_id = id)"


@on_graph("agg_04_degree", "SELECT id, i AS in_degree, o AS out_degree FROM deg", recursive=DEGREE)
def _(g):
    return agg.degrees(g)


@on_graph("agg_05_profile", "SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, max(i + o) AS max_degree, round(2.0 * sum(o) / count(*), 4) AS avg_degree, round(sum(o) / (count(*) * (count(*) - 1.0)), 8) AS density, round(count(*) / 1000.0 + sum(o) / 500.0, 3) AS load_seconds FROM deg", recursive=DEGREE)
def _(g):
    return agg.profile(g)


@on_graph("agg_05_histogram", "SELECT i + o AS degree, count(*) AS n FROM deg GROUP BY 1", recursive=DEGREE)
def _(g):
    return agg.degree_histogram(g)


@on_graph("agg_06_optimised", "SELECT node_type, count(*) AS n FROM g_nodes WHERE id IN (SELECT from_id FROM g_edges UNION SELECT to_id FROM g_edges) GROUP BY node_type")
def _(g):
    return agg.optimised(g).nodes.groupBy("node_type").agg(F.count("*").alias("n"))


@on_graph(
    "agg_07_partitions",
    "SELECT p AS partition, nodes, coalesce(edges, 0) AS edges, coalesce(cross_edges, 0) AS cross_edges FROM (SELECT coalesce(service, '__default__') AS p, count(*) AS nodes FROM g_nodes GROUP BY 1) LEFT JOIN (SELECT coalesce(a.service, '__default__') AS q, count(*) FILTER (coalesce(a.service, '') = coalesce(b.service, '')) AS edges, count(*) FILTER (coalesce(a.service, '') <> coalesce(b.service, '')) AS cross_edges FROM g_edges JOIN g_nodes a ON from_id = a.id JOIN g_nodes b ON to_id = b.id GROUP BY 1) ON p = q",
)
def _(g):
    return agg.partitions(g)


@on_graph("agg_09_batches", "SELECT CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) AS BIGINT) AS batch, id FROM g_nodes")
def _(g):
    return agg.chunks(g.nodes.select("id"), ["id"], 100).select("batch", "id")


@on_graph("agg_09_split", "SELECT p AS partition, CASE WHEN n > 500 THEN CAST(floor((k - 1) / 500) AS BIGINT) END AS sub, id FROM (SELECT coalesce(service, '__default__') AS p, id, row_number() OVER (PARTITION BY coalesce(service, '__default__') ORDER BY id) AS k, count(*) OVER (PARTITION BY coalesce(service, '__default__')) AS n FROM g_nodes)")
def _(g):
    return agg.split_partitions(g, 500)


HASHES = "man AS (SELECT p AS partition, n AS node_count, substr(sha256(p || '|' || n || '|' || s), 1, 16) AS content_hash FROM (SELECT coalesce(service, '__default__') AS p, count(*) AS n, sum(CAST('0x' || substr(sha256(id || '|' || node_type || '|' || name), 1, 12) AS BIGINT)) AS s FROM g_nodes GROUP BY 1))"


@on_graph("agg_10_manifest", "SELECT * FROM man", recursive=HASHES)
def _(g):
    return agg.manifest(g)


@query("agg_12_symbol_index", "SELECT canonical, count(*) AS n, min(p_type) AS first_type FROM (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g')) AS canonical, p_type FROM part) GROUP BY canonical")
def _(spark, d):
    return table(spark, d, "part").groupBy(fn.slug(F.col("p_name")).alias("canonical")).agg(F.count("*").alias("n"), F.min("p_type").alias("first_type"))


@query("agg_15_languages", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@on_graph("agg_16_clusters", "SELECT service, node_type, count(*) AS n FROM g_nodes WHERE service IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def _(g):
    return g.nodes.where("service is not null").groupBy("service", "node_type").agg(F.count("*").alias("n")).where("n >= 2")


@on_graph(
    "agg_20_complexity",
    "SELECT n.id, round(least(0.35 * (i + o) / (SELECT max(i + o) FROM deg) + 0.25 * length(name) / (SELECT max(length(name)) FROM g_nodes) + CASE WHEN EXISTS (SELECT 1 FROM g_edges JOIN g_nodes t ON to_id = t.id WHERE from_id = n.id AND t.service <> n.service) THEN 0.05 ELSE 0 END, 1), 4) AS complexity FROM g_nodes n JOIN deg ON n.id = deg.id",
    recursive=DEGREE,
)
def _(g):
    return agg.complexity(g)


@on_graph("agg_21_contexts", "SELECT domain, count(*) AS n FROM g_nodes WHERE domain IS NOT NULL GROUP BY domain HAVING count(*) >= 2")
def _(g):
    return g.nodes.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n")).where("n >= 2")


@on_graph("agg_22_kind", "SELECT CASE WHEN bool_or(node_type = 'ORDER') AND bool_or(node_type = 'PART') THEN 'trade' WHEN bool_or(node_type = 'PART') THEN 'catalogue' ELSE 'other' END AS kind FROM g_nodes")
def _(g):
    has = lambda t: F.bool_or(F.col("node_type") == t)
    return g.nodes.agg(F.when(has("ORDER") & has("PART"), "trade").when(has("PART"), "catalogue").otherwise("other").alias("kind"))


@query("agg_32_coupling", "SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return x.select("priority", *(F.coalesce(k, F.lit(0)).cast("long").alias(k.lower()) for k in ("F", "O", "P")))


@query("agg_33_job_metrics", "SELECT event_type, count(*) AS total, count(*) FILTER (value >= 50) AS done, count(*) FILTER (value < 50) AS failed, round(avg(value), 1) AS avg_value FROM events GROUP BY event_type")
def _(spark, d):
    return agg.job_metrics(table(spark, d, "events"))


@query("agg_34_job_feed", "SELECT event_id, 'EVT-' || upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 6)) AS job, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'low' ELSE 'info' END AS severity, strftime(ts, '%I:%M %p') AS at FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    e = table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(50)
    return e.select("event_id", F.concat(F.lit("EVT-"), F.upper(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 6))).alias("job"), F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "low").otherwise("info").alias("severity"), F.date_format("ts", "hh:mm a").alias("at"))


@on_graph("agg_36_index_advice", "SELECT node_type AS what, CASE WHEN count(*) > 1000 THEN 'high' ELSE 'medium' END AS priority FROM g_nodes GROUP BY 1 HAVING count(*) > 100 UNION ALL SELECT relation, 'medium' FROM g_edges GROUP BY 1 HAVING count(*) > 500")
def _(g):
    n = g.nodes.groupBy(F.col("node_type").alias("what")).count().where("count > 100").select("what", F.when(F.col("count") > 1000, "high").otherwise("medium").alias("priority"))
    return n.unionByName(g.edges.groupBy(F.col("relation").alias("what")).count().where("count > 500").select("what", F.lit("medium").alias("priority")))


# --- windows, top-k, sets -------------------------------------------------------------
@query("win_01_top_per_group", "SELECT l_suppkey, l_partkey, n, k AS rank FROM (SELECT l_suppkey, l_partkey, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS k FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k <= 4")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return win.top_per_group(n, ["l_suppkey"], [F.desc("n"), F.col("l_partkey")], 4)


@query("win_02_next_step", "SELECT conv_id, turn, role, next_role FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE next_role IS NOT NULL")
def _(spark, d):
    return win.next_rows(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], ["role"])


@query("win_04_keep_first", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("win_05_keep_best", "SELECT lang, arg_max(doc_id, n_chars * 10000000 - doc_id) AS doc_id FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query("win_06_chunks", "SELECT CAST(floor((k - 1) / 500) AS BIGINT) AS batch, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k, n_chars FROM documents) GROUP BY 1")
def _(spark, d):
    return agg.chunks(table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"], 500).groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("win_07_renumber", "SELECT source, CAST(dense_rank() OVER (ORDER BY source) AS BIGINT) AS number FROM (SELECT DISTINCT source FROM documents)")
def _(spark, d):
    return win.global_row_number(table(spark, d, "documents").select("source").distinct(), ["source"]).select("source", F.col("rn").cast("long").alias("number"))


@query("win_10_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    return win.latest(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("win_11_islands", "SELECT user_id, CAST(isl AS BIGINT) AS island, event_type, count(*) AS n FROM (SELECT *, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)) GROUP BY ALL")
def _(spark, d):
    return win.islands(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"))


def line_cursor(docs: DataFrame) -> DataFrame:
    """doc_id, line, cursor: the offset at which each line of a document begins."""
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return x.select("doc_id", F.col("line").cast("long").alias("line"), F.coalesce(F.sum(F.length("l") + 1).over(w), F.lit(0)).alias("cursor"))


@query("win_13_line_cursor", "SELECT doc_id, i AS line, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cursor FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)")
def _(spark, d):
    return line_cursor(table(spark, d, "documents"))


@on_graph("top_01_hubs", "SELECT n.id, name, node_type, service, i AS in_degree, o AS out_degree, i + o AS degree FROM g_nodes n JOIN deg ON n.id = deg.id ORDER BY degree DESC, n.id LIMIT 20", recursive=DEGREE)
def _(g):
    return agg.hubs(g)


@query("top_07_feed", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "event_type")


@query("set_01_union", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").unionAll(table(spark, d, "labels").select("doc_id"))


@query("set_03_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("set_04_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set_05_subset", "SELECT user_id, list_has_all(list(event_type), ['view', 'purchase']) AS buys FROM events GROUP BY user_id")
def _(spark, d):
    kinds = F.collect_set("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(kinds.alias("k")).select("user_id", (F.size(F.array_except(F.array(F.lit("view"), F.lit("purchase")), "k")) == 0).alias("buys"))


# --- scalar functions and tags -----------------------------------------------------------
@query("fun_01_slug", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9_]', '_', 'g'), '_') AS slug, 'cust__' || trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9_]', '_', 'g'), '_') AS id FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.slug(F.col("c_name")).alias("slug"), fn.node_id("cust", F.col("c_mktsegment")).alias("id"))


@query("fun_03_canonical", r"SELECT p_partkey, regexp_replace(lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')), '_+', '_', 'g') AS name FROM (SELECT p_partkey, trim(replace(p_name, ' ', 'X'), '_') AS x FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.canonical(F.replace("p_name", F.lit(" "), F.lit("X"))).alias("name"))


@query("fun_04_route", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', '') AS route FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", fn.route(fn.url_path(F.col("url"))).alias("route"))


@query("fun_09_collapse", r"SELECT doc_id, CASE WHEN length(x) <= 60 THEN x ELSE regexp_extract(substr(x, 1, 60), '^(.*) ', 1) || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.collapse(F.col("text"), 60).alias("short"))


@query("fun_10_clean", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS short FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.clean(F.col("text"), 100).alias("short"))


@query("fun_12_first_lines", "SELECT doc_id, CASE WHEN len(l) > 2 THEN array_to_string(l[1:2], chr(10)) || chr(10) || '... ' || (len(l) - 2) || ' more lines' ELSE text END AS head FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.first_lines(F.col("text"), 2).alias("head"))


@query("fun_15_method", "SELECT event_id, CASE WHEN regexp_matches(x, 'create|register|add|post') THEN 'POST' WHEN regexp_matches(x, 'update|edit|put|modify') THEN 'PUT' WHEN regexp_matches(x, 'delete|remove') THEN 'DELETE' WHEN regexp_matches(x, 'patch') THEN 'PATCH' ELSE 'GET' END AS method FROM (SELECT event_id, ['create_', 'edit_', 'remove_', 'patch_', 'list_'][event_id % 5 + 1] || event_type AS x FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", fn.http_method(F.concat(F.element_at(F.array(*map(F.lit, ("create_", "edit_", "remove_", "patch_", "list_"))), (F.col("event_id") % 5 + 1).cast("int")), "event_type")).alias("method"))


@on_graph("fun_17_tier", "SELECT id, CASE WHEN node_type IN ('REGION', 'NATION') THEN 'Reference' WHEN node_type IN ('CUSTOMER', 'SUPPLIER') THEN 'Party' WHEN node_type = 'PART' THEN 'Catalogue' ELSE 'Transaction' END AS tier, CASE WHEN regexp_matches(lower(name), 'customer') THEN 'Confidential' WHEN regexp_matches(lower(name), 'order|supplier') THEN 'Internal' ELSE 'Public' END AS sensitivity FROM g_nodes")
def _(g):
    return g.nodes.select("id", fn.tier(F.col("node_type")).alias("tier"), fn.sensitivity(F.col("name")).alias("sensitivity"))


@query("fun_26_signals", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in fn.STOP_WORDS) + ")))), ' ') AS signals FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(fn.signals(F.col("text")), " ").alias("signals"))


@query("fun_27_tokens", r"SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) * 1.3) + floor(len(regexp_extract_all(text, '[{}\[\]()=<>:;,./\\|@#$%^&*~`]')) * 0.3) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("fun_29_budget", "SELECT source, CAST(floor(sum(n_chars) * 8000.0 / (SELECT sum(n_chars) FROM documents)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def _(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("c"))
    return per.select("source", fn.budget_share(F.col("c"), F.sum("c").over(Window.partitionBy(F.lit(0))), 8000).cast("long").alias("tokens"))


@query("fun_30_duration", "SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", fn.duration(F.col("value") * 60).alias("took"))


@query("fun_31_safe_id", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS id FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", fn.safe_id(F.col("url")).alias("id"))


@query("tag_01_tags", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, 'tion') OR contains(t, 'ment') THEN 'animals' END, CASE WHEN contains(t, 'heit') OR contains(t, 'keit') THEN 'places' END, CASE WHEN contains(t, 'ción') THEN 'things' END, CASE WHEN contains(t, 'ing') THEN 'verbs' END], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(fn.tags(F.col("text"), TAGS), ",").alias("tags"))


@query("ext_03_statements", "SELECT doc_id, i + 1 AS statement, length(trim(s)) AS size FROM (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(text, '. ') AS x FROM documents)) WHERE length(trim(s)) > 0")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    return x.where(F.length(F.trim("s")) > 0).select("doc_id", (F.col("i") + 1).cast("long").alias("statement"), F.length(F.trim("s")).cast("long").alias("size"))


@query("fil_26_urls", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


# --- graph fix-points -------------------------------------------------------------------
@on_graph("grf_01_two_hops", "SELECT id, min(h) AS hop FROM hop WHERE id <> 'nation__3' GROUP BY id", recursive="both_ways AS (SELECT from_id AS a, to_id AS b FROM g_edges UNION SELECT to_id, from_id FROM g_edges), hop(id, h) AS (SELECT 'nation__3', 0 UNION SELECT b, h + 1 FROM hop JOIN both_ways ON a = id WHERE h < 2)")
def _(g):
    return grf.k_hop(g, g.nodes.where("id = 'nation__3'"), 2).select("id", "hop")


@on_graph("grf_02_downstream", "SELECT id, min(h) AS hop FROM hop WHERE id <> 'customer__7' GROUP BY id", recursive="hop(id, h) AS (SELECT 'customer__7', 0 UNION SELECT to_id, h + 1 FROM hop JOIN g_edges ON from_id = id WHERE h < 3)")
def _(g):
    return grf.k_hop(g, g.nodes.where("id = 'customer__7'"), 3, "out").select("id", "hop")


@on_graph("grf_03_hop_counts", "SELECT r AS seed, CAST(h AS INTEGER) AS hop, count(*) AS n FROM (SELECT r, id, min(h) AS h FROM hop WHERE r <> id GROUP BY r, id) GROUP BY ALL", recursive="hop(r, id, h) AS (SELECT id, id, 0 FROM g_nodes WHERE node_type = 'REGION' UNION SELECT r, from_id, h + 1 FROM hop JOIN g_edges ON to_id = id WHERE h < 2)")
def _(g):
    return grf.k_hop(g, rel.by_type(g, "REGION"), 2, "in").groupBy("seed", "hop").agg(F.count("*").alias("n"))


def _spread(rounds: int) -> str:
    """Label propagation: everyone at once takes the most frequent label around, the least of equals."""
    out = ["nb AS MATERIALIZED (SELECT from_id AS id, to_id AS o FROM g_edges WHERE from_id <> to_id UNION ALL SELECT to_id, from_id FROM g_edges WHERE from_id <> to_id), c0 AS MATERIALIZED (SELECT id, id AS c FROM g_nodes)"]
    for i in range(1, rounds + 1):
        out.append(f"v{i} AS (SELECT nb.id, c, count(*) AS n FROM nb JOIN c{i - 1} x ON x.id = nb.o GROUP BY ALL), c{i} AS MATERIALIZED (SELECT x.id, coalesce(b.c, x.c) AS c FROM c{i - 1} x LEFT JOIN (SELECT id, arg_min(c, (-n, c)) AS c FROM v{i} GROUP BY id) b USING (id))")
    return ", ".join(out)


@on_graph("grf_04_communities", "SELECT c AS community, count(*) AS n FROM c20 GROUP BY c", recursive=_spread(20))
def _(g):
    return grf.label_propagation(g).groupBy("community").agg(F.count("*").alias("n"))


#: Least label over rounds: enough for the diameter of the order graph, held against plain union-find in tests.
CONNECTED = "two_ways AS (SELECT from_id AS a, to_id AS b FROM g_edges UNION SELECT to_id, from_id FROM g_edges), " + ", ".join(
    ["w0 AS MATERIALIZED (SELECT id, id AS c FROM g_nodes)"] + [f"w{i} AS MATERIALIZED (SELECT w.id, least(w.c, coalesce(m.c, w.c)) AS c FROM w{i - 1} w LEFT JOIN (SELECT a AS id, min(c) AS c FROM two_ways JOIN w{i - 1} o ON o.id = b GROUP BY a) m USING (id))" for i in range(1, 13)]
) + ", reach AS (SELECT id, c AS b FROM w12)"


def _ranked(rounds: int) -> str:
    out = ["od AS MATERIALIZED (SELECT id, count(from_id) AS d, (SELECT count(*) FROM g_nodes) AS n FROM g_nodes LEFT JOIN g_edges ON from_id = id GROUP BY id), r0 AS MATERIALIZED (SELECT id, d, n, 1.0::DOUBLE / n AS r FROM od)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT o.id, d, n, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(x, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE d = 0) / n) AS r FROM od o LEFT JOIN (SELECT to_id AS id, sum(r / d) AS x FROM g_edges JOIN r{i - 1} ON id = from_id GROUP BY to_id) USING (id))")
    return ", ".join(out)


@on_graph("grf_05_pagerank", "SELECT id, round(r / (SELECT max(r) FROM r20), 6) AS rank FROM r20", recursive=_ranked(20))
def _(g):
    return grf.pagerank(g)


@on_graph("grf_06_components", "SELECT c AS component, count(*) AS n FROM (SELECT id, min(b) AS c FROM reach GROUP BY id) GROUP BY c", recursive=CONNECTED)
def _(g):
    return grf.components(g).groupBy("component").agg(F.count("*").alias("n"))


@on_graph("grf_07_closure", "SELECT a, b FROM reach", recursive="reach(a, b) AS (SELECT from_id, to_id FROM g_edges UNION SELECT a, to_id FROM reach JOIN g_edges ON from_id = b)")
def _(g):
    return grf.closure(g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@on_graph(
    "grf_08_lineage",
    "SELECT source, sink, length, CASE WHEN length <= 5 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT source, sink, min(l) AS length, row_number() OVER (PARTITION BY source ORDER BY min(l), sink) AS k FROM (SELECT a.from_id AS source, b.to_id AS sink, 3 AS l FROM g_edges a JOIN g_edges b ON a.to_id = b.from_id WHERE a.relation = 'PLACES' AND b.relation = 'CONTAINS') GROUP BY source, sink) WHERE k <= 50",
)
def _(g):
    return grf.lineage(g, rel.by_type(g, "CUSTOMER"), rel.by_type(g, "PART"), 3, ["PLACES", "CONTAINS"]).select("source", "sink", F.col("length").cast("long").alias("length"), "confidence")


TRADE = "SELECT DISTINCT c.c_nationkey AS a, s.s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey"


def trade(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("a", "b").distinct()


@query("grf_21_cycles", f"WITH t AS (SELECT a, b FROM ({TRADE}) WHERE a <> b) SELECT CAST(x.a AS VARCHAR) || '>' || x.b || '>' || y.b AS path FROM t x JOIN t y ON x.b = y.a JOIN t z ON y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b UNION ALL SELECT CAST(x.a AS VARCHAR) || '>' || x.b FROM t x JOIN t y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b")
def _(spark, d):
    return grf.cycles(trade(spark, d), 3).select("path")


@query("grf_22_reverse_pairs", f"WITH t AS ({TRADE}) SELECT a, b FROM t WHERE a < b AND EXISTS (SELECT 1 FROM t u WHERE u.a = t.b AND u.b = t.a)")
def _(spark, d):
    return rel.reverse_pairs(trade(spark, d))


# --- retrieval ---------------------------------------------------------------------------
@on_graph("ctx_08_rank")
def _(g):
    return ctx.ranked(g, "customer__7")


@on_graph("ctx_09_top")
def _(g):
    return ctx.top_context(ctx.ranked(g, "customer__7"), 10)


@query("ctx_11_budget", "SELECT source, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 8000")
def _(spark, d):
    return ctx.within_budget(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 8000).select("source", "doc_id", "running")


@on_graph("ctx_14_chunk", "SELECT n.id, '[' || node_type || '] ' || name || coalesce(' | service: ' || service, '') || coalesce(' | links: ' || l, '') AS chunk FROM g_nodes n LEFT JOIN (SELECT from_id, string_agg(t, ', ' ORDER BY k) AS l FROM (SELECT from_id, name AS t, row_number() OVER (PARTITION BY from_id ORDER BY name, relation) AS k FROM g_edges JOIN g_nodes ON to_id = id) WHERE k <= 5 GROUP BY from_id) ON from_id = n.id")
def _(g):
    return ctx.chunk_text(g)


@on_graph("ctx_15_delta", "SELECT 'add_nodes' AS kind, 'EUROPE' AS partition, count(*) AS n FROM g_nodes WHERE service = 'EUROPE' UNION ALL SELECT 'delete_partition', 'GONE', 1")
def _(g):
    new = agg.manifest(g)
    old = new.where("partition <> 'EUROPE'").unionByName(new.where("partition = 'ASIA'").withColumn("partition", F.lit("GONE")))
    return ctx.delta_operations(g, agg.delta(old, new))


# --- Markdown, streaming ---------------------------------------------------
@query("src_20_markdown", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), k AS (SELECT *, CASE WHEN regexp_matches(x, '^\s*$') THEN 'blank' WHEN regexp_matches(x, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(x, '^\s*([-*]|\d+\.) ') THEN 'list' WHEN regexp_matches(x, '^\|') THEN 'table' ELSE 'paragraph' END AS kind FROM l), p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM k) SELECT doc_id, CAST(isl AS BIGINT) AS island, kind, count(*) AS n_lines FROM (SELECT *, sum(CASE WHEN q = kind THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM p) WHERE kind <> 'blank' GROUP BY ALL")
def _(spark, d):
    return src.markdown_blocks(table(spark, d, "documents"), "doc_id")


@query("str_01_windowed", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return stream.drained(stream.windowed(stream.read_events(spark, d)))


@query("str_02_latest", "SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    return stream.drained(stream.latest_state(stream.read_events(spark, d))).select("user_id", "state")


from . import catalog_code, catalog_flows, catalog_rules, catalog_source, catalog_store  # noqa: E402,F401  they register their queries
