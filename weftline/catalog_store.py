"""More queries: graph files and exports read back, incremental tables, job states and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import on_graph, query
from .catalog_source import on_code
from .operators import renderers as out
from .operators.registry import Rules
from .plans.graph import table
from .session import shared
from .sources import graph_files as gf
from .streaming import events as stream
from .streaming.incremental import Store, job_states

Q = r"'''' || replace(replace({}, '\', '\\'), '''', '\''') || ''''"


# --- files read back -------------------------------------------------------------------
def _back(g, children: bool):
    spark = g.nodes.sparkSession
    path = shared(spark, "xml")
    gf.write_graph_xml(g, path)
    return gf.read_graph_xml(spark, path, children)[0]


@on_graph("src_08_graph_xml", "SELECT id, name, node_type, service, domain, 0 AS start_line, 0 AS n_params FROM g_nodes")
def _(g):
    return _back(g, True).nodes.select("id", "name", "node_type", "service", "domain", "start_line", F.size("params").alias("n_params"))


@on_graph("src_09_graph_xml_edges", "SELECT from_id, to_id, relation, weight FROM g_edges")
def _(g):
    return _back(g, False).edges.select("from_id", "to_id", "relation", "weight")


PLACED = "p AS (SELECT id, coalesce(service, '__default__') AS part FROM g_nodes), e AS (SELECT e.*, a.part AS a, b.part AS b FROM g_edges e JOIN p a ON a.id = from_id JOIN p b ON b.id = to_id)"


@on_graph("snk_16_partition_export", "SELECT part AS partition, count(*) AS node_count, (SELECT count(*) FROM e WHERE a = part AND b = part) AS edge_count, (SELECT count(*) FROM e WHERE a = part AND b <> part) AS cross_partition_edge_count, sum(length(name)) AS name_chars, (SELECT count(*) FROM e WHERE a <> b) AS all_cross FROM p JOIN g_nodes USING (id) GROUP BY part", recursive=PLACED)
def _(g):
    spark = g.nodes.sparkSession
    path = shared(spark, "export")
    gf.export_partitions(g, path)
    x = gf.read_export(spark, path)
    inner = x["edges"].groupBy("partition").agg(F.count("*").alias("read_edges"))
    names = x["nodes"].groupBy("partition").agg(F.count("*").alias("read_nodes"), F.sum(F.length("name")).alias("name_chars"))
    both = x["manifest"].join(names, "partition").join(inner, "partition", "left").where("read_nodes = node_count and coalesce(read_edges, 0) = edge_count")
    return both.crossJoin(x["cross_partition_edges"].agg(F.count("*").alias("all_cross"))).select("partition", "node_count", "edge_count", "cross_partition_edge_count", "name_chars", "all_cross")  # one row


BATCHES = f"""{PLACED}, n AS (SELECT '1_' || part AS batch, '1_node' AS kind, node_type AS label, (row_number() OVER (PARTITION BY part, node_type ORDER BY id) - 1) // 500 AS number, id,
  '{{' || concat_ws(', ', 'id: ' || {Q.format("id")}, 'name: ' || {Q.format("name")}, 'service: ' || {Q.format("service")}, 'domain: ' || {Q.format("domain")}) || '}}' AS props FROM g_nodes JOIN p USING (id)),
q AS (SELECT CASE WHEN a = b THEN '1_' || a ELSE '2_cross_partition' END AS batch, relation, from_id, to_id FROM e),
m AS (SELECT batch, '2_edge' AS kind, relation AS label, (row_number() OVER (PARTITION BY batch, relation ORDER BY from_id, to_id) - 1) // 500 AS number, from_id, to_id, '{{from: ' || {Q.format("from_id")} || ', to: ' || {Q.format("to_id")} || '}}' AS props FROM q)"""


@on_graph("snk_17_statement_batches", "SELECT batch, kind, label, number, 'UNWIND [' || string_agg(props, ', ' ORDER BY id) || '] AS row MERGE (n:' || label || ' {id: row.id}) SET n += row;' AS line FROM n GROUP BY batch, kind, label, number UNION ALL SELECT batch, kind, label, number, 'UNWIND [' || string_agg(props, ', ' ORDER BY from_id, to_id) || '] AS row MATCH (a {id: row.from}) MATCH (b {id: row.to}) MERGE (a)-[:' || label || ']->(b);' FROM m GROUP BY batch, kind, label, number", recursive=BATCHES)
def _(g):
    return gf.statement_batches(g)


@on_graph("snk_10_unwind_batches", "SELECT relation, number, 'UNWIND [' || string_agg(props, ', ' ORDER BY from_id, to_id) || '] AS row MATCH (a {id: row.from}) MATCH (b {id: row.to}) MERGE (a)-[:' || relation || ']->(b);' AS line FROM m GROUP BY relation, number", recursive=f"m AS (SELECT relation, from_id, to_id, (row_number() OVER (PARTITION BY relation ORDER BY from_id, to_id) - 1) // 500 AS number, '{{from: ' || {Q.format('from_id')} || ', to: ' || {Q.format('to_id')} || '}}' AS props FROM g_edges)")
def _(g):
    return out.unwind_edges(g.edges)


# --- streams ---------------------------------------------------------------------------
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


@query("str_03_incremental", "SELECT client_id, change_id, op, segment, city, balance FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY valid_at DESC NULLS LAST, seq DESC NULLS LAST, change_id DESC NULLS LAST) AS k FROM client_changes WHERE client_id IS NOT NULL) WHERE k = 1 AND NOT coalesce(op = 'D', false)")
def _(spark, d):
    path, types = shared(spark, "changes"), dict(c.split() for c in CHANGES.split(", "))
    rows = table(spark, d, "client_changes").select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))
    rows.repartition(4).write.parquet(f"{path}/in")  # four files, in any order: each is a micro-batch
    store = Store(spark, f"{path}/store", CHANGES, "client_id", ["valid_at", "seq", "change_id"], "segment", removed="op = 'D'")
    store.follow(spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), f"{path}/checkpoint")
    return store.table().select("client_id", "change_id", "op", "segment", "city", "balance")


@query("str_04_job_states", "SELECT job_id, CASE WHEN state NOT IN ('done', 'failed') AND at_us // 1000 + 86400000 * CAST(30 AS BIGINT) < (SELECT max(epoch_us(ts)) // 1000 - 86400000 FROM events) THEN 'timed_out' ELSE state END AS state, at_us FROM (SELECT user_id AS job_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, epoch_us(max(ts)) AS at_us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)")
def _(spark, d):
    path, e = shared(spark, "jobs"), table(spark, d, "events").where("ts is not null")
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()  # one row
    for i in range(4):  # one file after the other, as time goes
        a, b = ((lo or 0) + ((hi or 0) - (lo or 0)) * k // 4 for k in (i, i + 1))
        at = F.unix_micros("ts")
        e.where((at >= a) & ((at < b) if i < 3 else (at <= b))).coalesce(1).write.mode("append").parquet(f"{path}/in")
    s = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    said = stream.drained(job_states(s), "update")
    return said.groupBy("job_id").agg(F.max_by(F.struct("state", "at_us"), "batch").alias("j")).select("job_id", "j.state", "j.at_us")


# --- rules -----------------------------------------------------------------------------
RULES = Rules()


@RULES.rule("calls")
def _(g):
    return g.edges.where("relation = 'CALLS'")


@RULES.rule("a table that isn't there")
def _(g):
    return g.edges.select("from_id", "to_id", "relation", "no_such_column")


@RULES.rule("tables")
def _(g):
    return g.edges.where("relation like '%_TABLE'")


@RULES.rule("everything")
def _(g):
    return g.edges


@on_code("udf_01_rules", "SELECT from_id, to_id, relation, CASE WHEN relation = 'CALLS' THEN 'calls' WHEN relation LIKE '%_TABLE' THEN 'tables' ELSE 'everything' END AS rule FROM ce")
def _(g):
    return RULES.run(g.edges.sparkSession, g)[0]


@on_code("udf_01_outcomes", "SELECT 0 AS position, 'calls' AS rule, count(*) FILTER (WHERE relation = 'CALLS') AS edges, false AS failed FROM ce UNION ALL SELECT 1, 'a table that isn''t there', 0, true UNION ALL SELECT 2, 'tables', count(*) FILTER (WHERE relation LIKE '%_TABLE'), false FROM ce UNION ALL SELECT 3, 'everything', count(*), false FROM ce")
def _(g):
    return RULES.run(g.edges.sparkSession, g)[1].select("position", "rule", "edges", F.col("error").isNotNull().alias("failed"))
