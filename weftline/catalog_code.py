"""More queries: source texts, diagrams, statements, scores and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import CROSS, TRADE, on_graph, query, trade
from .operators import relational as rel
from .operators import renderers as out
from .plans.codebase import FILES_SQL, source_files
from .plans.graph import table
from .sources import code

SOURCES_SQL = f"WITH {FILES_SQL}"
LINES_SQL = f"{SOURCES_SQL}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM f)"


def on_files(name: str, sql: str | None = None, lines: bool = False):
    """A query whose function takes the source files of the code base."""

    def put(f):
        query(name, sql and f"{LINES_SQL if lines else SOURCES_SQL} {sql}")(lambda spark, d: f(source_files(spark, d).select("path", "text")))
        return f

    return put


# --- source texts -------------------------------------------------------------------
@on_files("ext_03_file_statements", r", s AS (SELECT path, unnest(regexp_split_to_array(text, ';\s*(?:\n|$)')) AS s, unnest(range(len(regexp_split_to_array(text, ';\s*(?:\n|$)')))) AS number FROM f), t AS (SELECT path, number, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM s) SELECT path, number, CASE WHEN regexp_matches(upper(s), '^(CREATE|ALTER|DROP|TRUNCATE)\b') THEN 'DDL' WHEN regexp_matches(upper(s), '^(INSERT|UPDATE|DELETE|MERGE)\b') THEN 'DML' ELSE 'QUERY' END AS kind, substr(s, 1, 200) AS preview FROM t WHERE s <> ''")
def _(f):
    return code.statements(f)


USES_SQL = ", u AS (SELECT DISTINCT path, relation, table_name FROM (" + " UNION ALL ".join(f"SELECT path, '{r}' AS relation, unnest(regexp_extract_all(lower(text), '{p}', 1)) AS table_name FROM f" for r, p in code.TABLE_USES.items()) + ") WHERE table_name NOT IN (" + ", ".join(f"'{w}'" for w in code.NOT_TABLES) + "))"


@on_files("rel_10_sql_lineage", USES_SQL + " SELECT * FROM u")
def _(f):
    return code.table_uses(f)


@on_files("agg_13_table_index", USES_SQL + " SELECT table_name, string_agg(DISTINCT relation, ',' ORDER BY relation) AS operations, count(DISTINCT path) AS n_files, min(path) FILTER (WHERE relation = 'CREATES_TABLE') AS defined_in FROM u GROUP BY table_name")
def _(f):
    return code.table_index(code.table_uses(f))


@on_files("rel_09_hierarchy", r", h AS (SELECT unnest(regexp_extract_all(text, '(class\s+\w+[^{:\n]*)', 1)) AS h FROM f), u AS (SELECT regexp_extract(h, 'class\s+(\w+)', 1) AS child, unnest(regexp_split_to_array(regexp_extract(h, '(?:extends\s+|\()([\w.]+(?:\s*,\s*[\w.]+)*)', 1), '\s*,\s*')) AS parent, 'EXTENDS' AS relation FROM h UNION ALL SELECT regexp_extract(h, 'class\s+(\w+)', 1), unnest(regexp_split_to_array(regexp_extract(h, 'implements\s+([\w.]+(?:\s*,\s*[\w.]+)*)', 1), '\s*,\s*')), 'IMPLEMENTS' FROM h) SELECT * FROM u WHERE parent <> ''")
def _(f):
    return code.hierarchy(f)


@on_files("rel_17_usages", r", d AS (SELECT DISTINCT path AS source, unnest(regexp_extract_all(text, '(?:class|def|function|interface)\s+([A-Za-z_]\w*)', 1)) AS name FROM f), w AS (SELECT DISTINCT path AS target, unnest(regexp_extract_all(text, '([A-Za-z_]\w*)', 1)) AS name FROM f) SELECT source, target, name FROM d JOIN w USING (name) WHERE source <> target")
def _(f):
    return code.usages(f)


IMPORTS_SQL = r""", sp AS (SELECT DISTINCT path, unnest(list_concat(regexp_extract_all(text, '(?m)^(?:from|import)\s+([\w.]+)', 1), regexp_extract_all(text, 'from\s+[''"]([^''"]+)[''"]', 1))) AS spec FROM f),
w AS (SELECT *, replace(regexp_replace(spec, '^(\.\.?/)+', ''), '.', '/') AS wanted FROM sp), k AS (SELECT path AS target, regexp_replace(path, '\.\w+$', '') AS whole, regexp_extract(path, '([^/]+?)(?:\.\w+)?$', 1) AS base FROM f),
m AS (SELECT path, spec, target, 1 AS rank FROM w JOIN k ON wanted = whole UNION ALL SELECT path, spec, target, 2 FROM w JOIN k ON regexp_extract(wanted, '([^/]+?)(?:\.\w+)?$', 1) = base)
SELECT path, spec, arg_min(target, (rank, target)) AS target, min(rank) AS rank FROM m WHERE path <> target GROUP BY path, spec"""


@on_files("rel_16_imports", IMPORTS_SQL)
def _(f):
    return code.resolved_imports(f)


@on_files("rel_39_handlers", r", r AS (SELECT path, line_no, regexp_extract(line, '@(?:\w+\.)?(?i:get|post|put|delete|patch)\(\s*[''\"]([^''\"]*)[''\"]', 1) AS route FROM l WHERE regexp_matches(line, '@(?:\w+\.)?(?i:get|post|put|delete|patch)\(\s*[''\"]([^''\"]+)[''\"]')), n AS (SELECT path, line_no, regexp_extract(line, '^\s*(?:async\s+)?(?:def|function)?\s*([a-z_]\w*)\s*\(', 1) AS name FROM l) SELECT r.path, r.line_no, route, arg_min(name, n.line_no) AS handler FROM r LEFT JOIN n ON n.path = r.path AND n.line_no BETWEEN r.line_no + 1 AND r.line_no + 4 AND name <> '' GROUP BY ALL", lines=True)
def _(f):
    return code.handlers(f)


@on_files("win_12_brace_depth", "SELECT path, line_no, CAST(sum(len(regexp_extract_all(line, '\\{')) - len(regexp_extract_all(line, '\\}'))) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) AS depth FROM l", lines=True)
def _(f):
    return code.brace_depth(f)


DDL_SQL = r""", t AS (SELECT unnest(regexp_extract_all(lower(text), '(create\s+table\s+(?:if\s+not\s+exists\s+)?\w+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))', 1)) AS t FROM f),
b AS (SELECT regexp_extract(t, 'table\s+(?:if\s+not\s+exists\s+)?(\w+)', 1) AS table_name, regexp_replace(regexp_replace(regexp_extract(t, '(?s)\((.*)\)$', 1), '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g') AS body FROM t),
c AS (SELECT table_name, trim(regexp_replace(unnest(string_split(body, ',')), '\s+', ' ', 'g')) AS c FROM b)
SELECT table_name, regexp_extract(c, '^(\w+)', 1) AS column_name, regexp_extract(c, '^\w+\s+(\w+)', 1) AS column_type, CASE WHEN regexp_extract(c, '^(\w+)', 1) = 'id' THEN 'PK' WHEN regexp_extract(c, '^(\w+)', 1) LIKE '%\_id' ESCAPE '\' THEN 'FK' ELSE '' END AS role
FROM c WHERE c <> '' AND NOT regexp_matches(c, '^(?:primary|foreign|unique|constraint|check|index|key)\b')"""


@on_files("ext_05_columns", DDL_SQL)
def _(f):
    return code.ddl_columns(f)


@on_files("ext_07_stereotypes", r", m AS (SELECT path, unnest(regexp_extract_all(text, '(@\w+\s+(?:public\s+)?class\s+\w+)', 1)) AS m FROM f) SELECT path, regexp_extract(m, 'class\s+(\w+)', 1) AS name, regexp_extract(m, '@(\w+)', 1) AS stereotype FROM m")
def _(f):
    return code.stereotypes(f)


@on_files("ext_11_errors", r"SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?:raise|throw new)\s+(\w+)', 1)) AS error FROM f")
def _(f):
    return code.matches(f, r"(?:raise|throw new)\s+(\w+)", "error")


@on_files("ext_13_type_links", r"SELECT DISTINCT path, t AS type FROM (SELECT path, unnest(regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9_]+)', 1)) AS t FROM f) WHERE t IN (SELECT unnest(regexp_extract_all(text, 'class\s+(\w+)', 1)) FROM f)")
def _(f):
    return code.matches(f, r"\b([A-Z][a-zA-Z0-9_]+)", "type").join(code.matches(f, r"class\s+(\w+)", "type").select("type"), "type", "left_semi").select("path", "type")


@on_files("tag_03_collections", r", m AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, 'db\.(\w+\.\w+)\(', 1)) AS m FROM f) SELECT path, split_part(m, '.', 1) AS collection, CASE WHEN regexp_matches(split_part(m, '.', 2), '^(insert|update|delete|replace)') THEN 'WRITES' WHEN split_part(m, '.', 2) = 'aggregate' THEN 'AGGREGATES' ELSE 'READS' END AS use FROM m")
def _(f):
    return code.collection_uses(f)


@on_files("fil_26_quoted_urls", r"SELECT DISTINCT path, unnest(regexp_extract_all(text, '[''\"](/[\w/{}-]+)[''\"]', 1)) AS url FROM f")
def _(f):
    return code.matches(f, "['\"](/[\\w/{}-]+)['\"]", "url")


@on_files("src_17_sniffed_sql", "SELECT path, regexp_matches(substr(text, 1, 4096), '(?i)\\b(?:CREATE\\s+(?:DEFINER|OR\\s+REPLACE|PROCEDURE|FUNCTION)|BEGIN|DELIMITER|INSERT\\s+INTO)\\b') AS is_sql FROM f")
def _(f):
    return f.select("path", F.substring("text", 1, 4096).rlike(r"(?i)\b(?:CREATE\s+(?:DEFINER|OR\s+REPLACE|PROCEDURE|FUNCTION)|BEGIN|DELIMITER|INSERT\s+INTO)\b").alias("is_sql"))


@on_files("doc_08_injected", "SELECT path, string_agg(line, chr(10) ORDER BY line_no, kind) AS text FROM (SELECT path, line_no, 1 AS kind, line FROM l UNION ALL SELECT path, 1, 0, '# ' || path FROM f) GROUP BY path", lines=True)
def _(f):
    return code.injected(f, f.select("path", F.lit(1).alias("line_no"), F.concat(F.lit("# "), "path").alias("comment")))


# --- statements and diagrams -----------------------------------------------------------
@on_graph("snk_11_node_statements", r"SELECT id, 'MERGE (:' || node_type || ' {' || concat_ws(', ', 'id: ''' || id || '''', 'name: ''' || replace(replace(name, '\', '\\'), '''', '\''') || '''', 'service: ''' || service || '''', 'domain: ''' || replace(replace(domain, '\', '\\'), '''', '\''') || '''') || '});' AS line FROM g_nodes")
def _(g):
    return out.node_statements(g.nodes)


@on_graph("snk_10_edge_statements", "SELECT from_id, to_id, 'MATCH (a {id: ''' || from_id || '''}), (b {id: ''' || to_id || '''}) MERGE (a)-[:' || relation || ']->(b);' AS line FROM g_edges")
def _(g):
    return out.edge_statements(g.edges)


@on_graph("snk_09_memory", "SELECT round(mb, 3) AS data_mb, round(greatest(512.0::DOUBLE, mb * 1.5), 3) AS heap_mb, round(greatest(256.0::DOUBLE, mb * 0.8), 3) AS cache_mb FROM (SELECT ((SELECT count(*) FROM g_nodes) * 500 + (SELECT count(*) FROM g_edges) * 200) * 1.3::DOUBLE / 1048576 AS mb)")
def _(g):
    return out.memory_estimate(g)


@on_graph("snk_30_duplicate_nodes", "SELECT name, node_type, count(*) AS n, min(id) AS kept FROM g_nodes GROUP BY name, node_type HAVING count(*) > 1")
def _(g):
    return g.nodes.groupBy("name", "node_type").agg(F.count("*").alias("n"), F.min("id").alias("kept")).where("n > 1")


CHART_SQL = f"SELECT '0' AS at, 'flowchart LR' AS line UNION ALL SELECT '1:' || source || ':' || target, '  ' || regexp_replace(source, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || n || '| ' || regexp_replace(target, '[^A-Za-z0-9]', '_', 'g') FROM (SELECT source, target, sum(n)::BIGINT AS n FROM ({CROSS}) GROUP BY ALL)"


def chart(g) -> DataFrame:
    return out.flow_chart(rel.cross_counts(g).groupBy("source", "target").agg(F.sum("n").alias("n")))


@on_graph("doc_03_flow_chart", CHART_SQL)
def _(g):
    return chart(g)


@on_graph("fil_20_chart_check", f"SELECT *, n_edges >= 1 AND n_nodes >= 2 AS valid FROM (SELECT count(*) AS n_edges FROM (SELECT DISTINCT source, target FROM ({CROSS}))), (SELECT count(*) AS n_nodes FROM (SELECT source FROM ({CROSS}) UNION SELECT target FROM ({CROSS})))")
def _(g):
    return out.chart_faults(chart(g))


@query("doc_05_steps", "SELECT n_name AS actor, r_name AS other, 'belongs' AS action FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    s = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit(" → "), "r_name", F.lit(": belongs")).alias("step"))
    return s.select(*out.steps(F.col("step")))


@query("doc_09_restated", "SELECT p_partkey, 2 * len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')), regexp_extract_all(lower(p_type), '[a-z]+'))) >= len(list_distinct(regexp_extract_all(lower(p_name), '[a-z]+'))) AS restated FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", out.restated(F.col("p_name"), F.col("p_type")).alias("restated"))


# --- joins and aggregates --------------------------------------------------------------
@on_graph("rel_24_cross_edges", "SELECT from_id, to_id, relation FROM g_edges JOIN g_nodes a ON from_id = a.id JOIN g_nodes b ON to_id = b.id WHERE coalesce(a.service, '__default__') <> coalesce(b.service, '__default__')")
def _(g):
    key = g.nodes.select("id", F.coalesce("service", F.lit("__default__")).alias("part"))
    ends = g.edges.join(key.toDF("from_id", "from_part"), "from_id").join(key.toDF("to_id", "to_part"), "to_id")
    return ends.where("from_part <> to_part").select("from_id", "to_id", "relation")


@on_graph("agg_08_partition_edges", "SELECT coalesce(a.service, '__default__') AS partition, count(*) FILTER (WHERE coalesce(a.service, '__default__') = coalesce(b.service, '__default__')) AS inside, count(*) FILTER (WHERE coalesce(a.service, '__default__') <> coalesce(b.service, '__default__')) AS outgoing FROM g_edges JOIN g_nodes a ON from_id = a.id JOIN g_nodes b ON to_id = b.id GROUP BY 1")
def _(g):
    key = g.nodes.select("id", F.coalesce("service", F.lit("__default__")).alias("part"))
    ends = g.edges.join(key.toDF("from_id", "partition"), "from_id").join(key.toDF("to_id", "to_part"), "to_id")
    same = F.col("partition") == F.col("to_part")
    return ends.groupBy("partition").agg(F.count_if(same).alias("inside"), F.count_if(~same).alias("outgoing"))


@on_graph("agg_24_neighbour_types", "SELECT id, node_type, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, node_type) AS k FROM (SELECT e.id, node_type, count(*) AS n FROM (SELECT from_id AS id, to_id AS other FROM g_edges UNION ALL SELECT to_id, from_id FROM g_edges) e JOIN g_nodes o ON o.id = other GROUP BY ALL)) WHERE k <= 5")
def _(g):
    both = g.edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(g.edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    n = both.join(g.nodes.select(F.col("id").alias("other"), "node_type"), "other").groupBy("id", "node_type").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "node_type"))).where("k <= 5").drop("k")


@query("agg_25_tiers", "SELECT source, lang, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) >= 1 THEN 'medium' END AS tier FROM documents GROUP BY source, lang")
def _(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("tier", F.when(F.col("n") >= 3, "high").when(F.col("n") >= 1, "medium"))


@query("agg_29_strength", f"WITH t AS ({TRADE}) SELECT a, count(*) AS n, CASE WHEN count(*) > 3 THEN 'High' WHEN count(*) > 1 THEN 'Medium' ELSE 'Low' END AS strength, bool_or(EXISTS (SELECT 1 FROM t u WHERE u.a = t.b AND u.b = t.a)) AS circular FROM t WHERE a <> b GROUP BY a")
def _(spark, d):
    t = trade(spark, d).where("a <> b")
    back = t.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    n = t.join(back, ["a", "b"], "left").groupBy("a").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("back"), F.lit(False)).alias("circular"))
    return n.withColumn("strength", F.when(F.col("n") > 3, "High").when(F.col("n") > 1, "Medium").otherwise("Low"))


#: Words of each subject and what a match weighs.
SUBJECTS = {"trade": (3, ["market", "price", "bank"]), "learning": (2, ["school", "student", "book"]), "nature": (4, ["river", "water", "tree"])}


@query("agg_30_subject_scores", "SELECT subject, round(score / greatest(max(score) OVER (), 1), 6) AS score FROM (SELECT subject, CAST(sum(w * h) AS DOUBLE) AS score FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS subject, {w} AS w, CAST(regexp_matches(lower(text), '\\b({'|'.join(ks)})\\b') AS INT) AS h FROM benchmark" for s, (w, ks) in SUBJECTS.items()) + ") GROUP BY subject)")
def _(spark, d):
    sums = [F.sum(F.lower("text").rlike(rf"\b({'|'.join(ks)})\b").cast("int") * w).cast("double").alias(s) for s, (w, ks) in SUBJECTS.items()]
    scores = table(spark, d, "benchmark").agg(*sums).unpivot([], list(SUBJECTS), "subject", "score")
    return scores.select("subject", F.round(F.col("score") / F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1.0)), 6).alias("score"))  # a row per subject


@on_graph("agg_37_pattern_scores", "SELECT pattern, score FROM (SELECT least(1.0, 0.1 * count(*) FILTER (WHERE node_type = 'REGION'))::DOUBLE AS hub, least(1.0, 0.01 * count(*) FILTER (WHERE node_type = 'ORDER'))::DOUBLE AS ledger, least(1.0, 0.02 * count(DISTINCT service))::DOUBLE AS federated FROM g_nodes) UNPIVOT (score FOR pattern IN (hub, ledger, federated))")
def _(g):
    t = F.col("node_type")
    one = lambda c: F.least(F.lit(1.0), c)
    sums = g.nodes.agg(one(F.count_if(t == "REGION") * 0.1).alias("hub"), one(F.count_if(t == "ORDER") * 0.01).alias("ledger"), one(F.count_distinct("service") * 0.02).alias("federated"))
    return sums.unpivot([], ["hub", "ledger", "federated"], "pattern", "score")


@query("agg_40_mechanisms", "SELECT mechanism, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY doc_id) AS k FROM (SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'password|secret') THEN 'secrets' WHEN regexp_matches(lower(text), 'token|key') THEN 'tokens' WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'licences' END AS mechanism FROM documents) WHERE mechanism IS NOT NULL) WHERE k <= 3")
def _(spark, d):
    t = F.lower("text")
    kind = F.when(t.rlike("password|secret"), "secrets").when(t.rlike("token|key"), "tokens").when(t.rlike("licen[cs]e"), "licences")
    found = table(spark, d, "documents").select("doc_id", kind.alias("mechanism")).where("mechanism is not null")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("mechanism").orderBy("doc_id"))).where("k <= 3").drop("k")


@query("rel_46_named_lists", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS names FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return e.select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ">").alias("names"))


@query("agg_19_flow_summary", "SELECT conv_id, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, max_by(role, turn) AS exit_role FROM conversations GROUP BY conv_id")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max_by("role", "turn").alias("exit_role"))


@query("rel_48_direction", f"WITH t AS (SELECT * FROM ({TRADE}) WHERE a <> b) SELECT n_nationkey, CASE WHEN o AND i THEN 'Bidirectional' WHEN o THEN 'Outbound' WHEN i THEN 'Inbound' END AS direction FROM (SELECT n_nationkey, n_nationkey IN (SELECT a FROM t) AS o, n_nationkey IN (SELECT b FROM t) AS i FROM nation)")
def _(spark, d):
    t = trade(spark, d).where("a <> b")
    ends = t.select(F.col("a").alias("n_nationkey"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(t.select(F.col("b").alias("n_nationkey"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    known = ends.groupBy("n_nationkey").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    way = F.when(F.expr("o = 1 and i = 1"), "Bidirectional").when(F.col("o") == 1, "Outbound").when(F.col("i") == 1, "Inbound")
    return table(spark, d, "nation").select("n_nationkey").join(known, "n_nationkey", "left").select("n_nationkey", way.alias("direction"))


# --- windows, order, sets ----------------------------------------------------------------
@query("win_03_stage_pairs", "SELECT conv_id, role || ' → ' || nxt AS pair FROM (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def _(spark, d):
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", F.concat("role", F.lit(" → "), nxt).alias("pair")).where("pair is not null")


@on_graph("win_08_ranked_types", "SELECT node_type, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT node_type, count(*) AS n FROM g_nodes GROUP BY node_type)")
def _(g):
    n = g.nodes.groupBy("node_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))  # a row per type


@query("set_02_union_lists", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def _(spark, d):
    lists = table(spark, d, "documents").groupBy("source", "doc_id").agg(F.collect_set("lang").alias("l"))
    return lists.groupBy("source").agg(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))), ","), F.lit("")).alias("langs"))


@query("set_05_lifecycle", "SELECT user_id, bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase') AS complete FROM events GROUP BY user_id")
def _(spark, d):
    have = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return have.select("user_id", (F.size(F.array_except(F.array(F.lit("signup"), F.lit("purchase")), "have")) == 0).alias("complete"))


# --- scalar functions ----------------------------------------------------------------------
@query("fun_06_paths", r"SELECT page_id, regexp_extract(url, '([^/]+?)(?:\.\w+)?$', 1) AS stem, regexp_replace(url, '/[^/]*$', '') AS parent FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", code.stem(F.col("url")).alias("stem"), F.regexp_replace("url", "/[^/]*$", "").alias("parent"))


@query("fun_11_escapes", r"SELECT p_partkey, '''' || replace(replace(p_name, '\', '\\'), '''', '\''') || '''' AS quoted FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", out.quoted(F.col("p_name")).alias("quoted"))


@query("fun_36_built_ins", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%I:%M %p') AS clock FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "hh:mm a").alias("clock"))
