"""More queries: symbols and scopes of the code base made from the tables, its graph, lineage, request flows and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query
from .functions import scalars as fn
from .operators import aggregates as agg
from .operators import compression as cmp
from .operators import lineage as lin
from .operators import links as lnk
from .operators import renderers as out
from .operators import retrieval as ctx
from .operators import scopes
from .operators.graphs import k_hop
from .plans.codebase import FILES_SQL, source_files
from .plans.codegraph import CODE_SQL, ELEMENT, FETCH, HOOK, ROUTE, _sql_list, code_graph, file_calls
from .plans.graph import Graph, table
from .sources import files as src


def on_code(name: str, sql: str | None = None, recursive: str | None = None):
    """A query whose function takes the code graph."""

    def put(f):
        query(name, sql and f"WITH RECURSIVE {CODE_SQL}{', ' + recursive if recursive else ''} {sql}")(lambda spark, d: f(code_graph(spark, d)))
        return f

    return put


# --- symbols and scopes -------------------------------------------------------------
@on_code("ext_01_symbols", "SELECT path, language, line_no, end_line, kind, name, qualified, parent FROM sy")
def _(g):
    return g.symbols.select("path", "language", "line_no", "end_line", "kind", "name", "qualified", "parent")


@on_code("ext_02_heads", "SELECT id, params, is_async, is_exported, decorator, node_type FROM sy")
def _(g):
    return g.symbols.select("id", "params", "is_async", "is_exported", "decorator", "node_type")


@on_code("ext_01_owned_lines", "SELECT path, line_no, owner, owner_line FROM ow")
def _(g):
    return g.owned.select("path", "line_no", "owner", "owner_line")


@on_code("src_02_symbols", "SELECT path, name, kind, parent, line_no AS start_line FROM sy")
def _(g):
    return g.symbols.select("path", "name", "kind", "parent", F.col("line_no").alias("start_line"))


@on_code("rel_08_calls", "SELECT DISTINCT ca.path, cs.name AS caller, ca.name AS callee FROM ca JOIN cs ON cs.path = ca.path AND cs.line_no = ca.owner_line JOIN fn ON fn.path = ca.path AND fn.name = ca.name WHERE cs.name <> ca.name")
def _(g):
    return file_calls(g)


@query("ext_04_endpoints", f"WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_1 FROM f) SELECT * FROM (SELECT path, upper(regexp_extract(line, '@\\w+\\.(get|post|put|delete|patch)\\(', 1)) AS method, regexp_extract(line, '\\(\\s*[''\"]([^''\"]+)[''\"]', 1) AS route, line_1 AS line FROM l WHERE regexp_matches(line, '@\\w+\\.(get|post|put|delete|patch)\\(\\s*[''\"]([^''\"]+)[''\"]'))")
def _(spark, d):
    return src.endpoints(source_files(spark, d))


@on_code("src_02_code_nodes", "SELECT * FROM cn")
def _(g):
    return g.nodes


@on_code("rel_07_code_edges", "SELECT * FROM ce")
def _(g):
    return g.edges


# --- lineage ---------------------------------------------------------------------------
WALKS = f"""pe AS (SELECT to_id AS id, from_id, bool_or(relation = 'CALLS') AS calls FROM ce WHERE relation IN {_sql_list(lin.FOLLOWED)} GROUP BY ALL),
pr AS (SELECT id, list(from_id ORDER BY from_id DESC) FILTER (WHERE calls) AS callers, list(from_id ORDER BY from_id) FILTER (WHERE NOT calls) AS others FROM pe GROUP BY id),
ac AS (SELECT from_id, to_id, relation, min(confidence) AS confidence FROM ce WHERE relation IN {_sql_list(lin.ACCESSES)} GROUP BY ALL),
wk AS (SELECT DISTINCT from_id AS id, from_id AS at, [from_id] AS path FROM ac
  UNION ALL SELECT id, new, list_prepend(new, path) FROM (SELECT wk.id, path, list_filter(list_concat(coalesce(callers, []), coalesce(others, [])), lambda x: NOT list_contains(path, x))[1] AS new FROM wk JOIN pr ON pr.id = wk.at) WHERE new IS NOT NULL AND len(path) <= 15),
ch AS (SELECT ac.to_id AS table_id, ac.from_id AS accessor, relation, confidence, list_append(path, to_id) AS path FROM ac JOIN (SELECT id, arg_max(path, len(path)) AS path FROM wk GROUP BY id) w ON w.id = ac.from_id)"""


@on_code("grf_09_sql_lineage", "SELECT table_id, accessor, relation, confidence, array_to_string(path, ' > ') AS path, len(path) AS length FROM ch", recursive=WALKS)
def _(g):
    return lin.sql_lineage(g, tell=False).select("table_id", "accessor", "relation", "confidence", F.array_join("path", " > ").alias("path"), F.size("path").cast("long").alias("length"))


@on_code("grf_11_lineage_edges", "SELECT path[1] AS from_id, path[-1] AS to_id, arg_min(confidence, (table_id, accessor, relation)) AS confidence, 'FEEDS_DATA_TO' AS relation FROM ch WHERE path[1] <> path[-1] GROUP BY ALL", recursive=WALKS)
def _(g):
    return lin.lineage_edges(lin.sql_lineage(g, tell=False))


def _searched(depth: int) -> str:
    """One CTE a level: candidates with the place of the first node before, placed, and cut at the first data node."""
    steps = [
        f"""ge AS (SELECT from_id, to_id, min(relation) AS relation, any_value(n.node_type IN {_sql_list(lin.DATA_TYPES)}) AS data FROM ce JOIN cn n ON n.id = to_id WHERE relation IN {_sql_list(lin.FLOWS + lin.DATA_ACCESS)} GROUP BY ALL),
st AS (SELECT id, name AS label, 1 AS strategy FROM cn WHERE node_type = 'API_ENDPOINT' UNION ALL SELECT m.id, c.name || '.' || m.name, 2 FROM ce JOIN cn c ON c.id = from_id AND c.node_type = 'CONTROLLER' JOIN cn m ON m.id = to_id AND m.node_type IN ('FUNCTION', 'ASYNC_FUNCTION', 'METHOD') WHERE relation IN ('DEFINES', 'CONTAINS')),
b0 AS MATERIALIZED (SELECT DISTINCT id AS seed, id, 1 AS step, false AS over FROM st), r0 AS MATERIALIZED (SELECT seed, id, step FROM b0)"""
    ]
    for i in range(1, depth + 1):
        steps.append(
            f"""c{i} AS (SELECT seed, to_id AS id, data, min((step, to_id, relation)) AS first FROM b{i - 1} b JOIN ge ON from_id = b.id WHERE NOT over AND NOT EXISTS (SELECT 1 FROM r{i - 1} r WHERE r.seed = b.seed AND r.id = to_id) GROUP BY ALL),
p{i} AS (SELECT seed, id, data, (SELECT max(step) FROM r{i - 1} r WHERE r.seed = c{i}.seed) + row_number() OVER (PARTITION BY seed ORDER BY first) AS step FROM c{i}),
q{i} AS (SELECT *, min(step) FILTER (WHERE data) OVER (PARTITION BY seed) AS stop FROM p{i}),
b{i} AS MATERIALIZED (SELECT seed, id, step, stop IS NOT NULL AS over FROM q{i} WHERE stop IS NULL OR step <= stop), r{i} AS MATERIALIZED (SELECT * FROM r{i - 1} UNION ALL SELECT seed, id, step FROM b{i})"""
        )
    return ",\n".join(steps)


TIER = "CASE node_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lin.TIERS.items()) + " ELSE 'Other' END"
REQUESTS = f"""{WALKS},
{_searched(8)},
fl AS (SELECT seed AS id, list(name ORDER BY step) AS steps, list({TIER} ORDER BY step) AS step_types FROM r8 JOIN cn USING (id) GROUP BY seed HAVING count(*) >= 2),
ls AS (SELECT table_id || '|' || accessor || '|' || relation AS id, 'SQL lineage to table ''' || t.name || ''' via ' || a.name AS label, confidence, ch.path FROM ch JOIN cn t ON t.id = table_id JOIN cn a ON a.id = accessor WHERE len(ch.path) >= 3),
lf AS (SELECT ls.id, label, confidence, list(name ORDER BY step) AS steps, list({TIER} ORDER BY step) AS step_types FROM (SELECT id, label, confidence, unnest(path) AS node, unnest(range(len(path))) AS step FROM ls) ls JOIN cn ON cn.id = node GROUP BY ALL),
al AS (SELECT fl.id, label, strategy, steps, step_types, CASE WHEN len(steps) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM fl JOIN st USING (id) UNION ALL SELECT id, label, 3, steps, step_types, confidence FROM lf)"""


@on_code("grf_16_request_flows", "SELECT name, strategy, array_to_string(steps, ' > ') AS steps, array_to_string(step_types, ' > ') AS step_types, steps[1] AS entry_point, steps[-1] AS exit_point, len(steps) AS hop_count, confidence FROM (SELECT label AS name, strategy, steps, step_types, confidence, row_number() OVER (PARTITION BY label ORDER BY strategy, id) AS k FROM al) WHERE k = 1", recursive=REQUESTS)
def _(g):
    f = lin.request_flows(g, lin.sql_lineage(g))
    return f.select("name", "strategy", F.array_join("steps", " > ").alias("steps"), F.array_join("step_types", " > ").alias("step_types"), "entry_point", "exit_point", "hop_count", "confidence")


# --- links -----------------------------------------------------------------------------
ROUTE_LINKS = r"""ix AS (SELECT pattern, max(path) AS target, regexp_replace(pattern, '/+$', '') AS r FROM ro GROUP BY pattern)
SELECT DISTINCT path, url, arg_min(target, pattern) AS target, min(pattern) AS pattern FROM ca2 JOIN ix ON target <> path AND (starts_with(u, r) OR starts_with(r, u)) GROUP BY path, url"""


@on_code("rel_18_api_links", f"SELECT * FROM (WITH ro AS (SELECT cs.path, route AS pattern FROM rt JOIN cs USING (id)), ca2 AS (SELECT path, url, regexp_replace(url, '/+$', '') AS u FROM (SELECT path, unnest(regexp_extract_all(line, '{FETCH}', 1)) AS url FROM ow)), {ROUTE_LINKS})")
def _(g):
    routes = g.symbols.select("path", F.regexp_extract("decorator", ROUTE, 1).alias("pattern")).where("pattern <> ''")
    return lnk.first_prefix_match(scopes.matches(g.owned, FETCH, "url"), routes)


HREF = r'href="(/[^"]*)"'


@query("rel_18_page_links", f"SELECT * FROM (WITH ro AS (SELECT CAST(page_id AS VARCHAR) AS path, unnest(regexp_extract_all(html, '{HREF}', 1)) AS pattern FROM pages), ca2 AS (SELECT CAST(page_id AS VARCHAR) AS path, regexp_replace(url, '^[a-z]+://[^/]*', '') AS url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/+$', '') AS u FROM pages WHERE url IS NOT NULL), {ROUTE_LINKS})")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("path", F.col("page_id").cast("string"))
    return lnk.first_prefix_match(p.where("url is not null").select("path", fn.url_path(F.col("url")).alias("url")), p.select("path", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("pattern")))


REACT = f"""rm AS (SELECT DISTINCT path, owner, kind, name FROM (SELECT path, owner, 'hook' AS kind, unnest(regexp_extract_all(line, '{HOOK}', 1)) AS name FROM ow WHERE language = 'typescript'
  UNION ALL SELECT path, owner, 'element', unnest(regexp_extract_all(line, '{ELEMENT}', 1)) FROM ow WHERE language = 'typescript' UNION ALL SELECT path, owner, 'call', unnest(regexp_extract_all(line, '{FETCH}', 1)) FROM ow WHERE language = 'typescript')),
rf AS (SELECT rm.kind, rm.name, coalesce((SELECT arg_min(id, node_type = 'CLASS') FROM cn WHERE cn.path = rm.path AND cn.name = rm.owner AND node_type IN ('REACT_COMPONENT', 'CLASS')), rm.path) AS from_id FROM rm),
ra AS (SELECT from_id, rf.name AS url, (SELECT arg_min(id, cn.name) FROM cn WHERE node_type = 'API_ENDPOINT' AND (starts_with(regexp_replace(rf.name, '/+$', ''), regexp_replace(cn.name, '/+$', '')) OR starts_with(regexp_replace(cn.name, '/+$', ''), regexp_replace(rf.name, '/+$', '')))) AS hit FROM rf WHERE kind = 'call')"""


def _react(g):
    front = g.owned.where("language = 'typescript'")
    found = [scopes.matches(front, p, "name").select("path", "owner", F.lit(k).alias("kind"), "name") for k, p in (("hook", HOOK), ("element", ELEMENT), ("call", FETCH))]
    return lnk.react_links(g.symbols, g.nodes, reduce(DataFrame.unionByName, found))


@on_code("rel_11_react_edges", "SELECT from_id, to_id, 'USES_HOOK' AS relation FROM rf JOIN (SELECT name, max(id) AS to_id FROM cn WHERE node_type = 'REACT_HOOK' GROUP BY name) USING (name) WHERE kind = 'hook' UNION SELECT from_id, to_id, 'RENDERS' FROM rf JOIN (SELECT name, max(id) AS to_id FROM cn WHERE node_type = 'REACT_COMPONENT' GROUP BY name) USING (name) WHERE kind = 'element' AND from_id <> to_id UNION SELECT from_id, coalesce(hit, 'api::' || url), 'CALLS_API' FROM ra", recursive=REACT)
def _(g):
    return _react(g)[0]


@on_code("rel_11_new_endpoints", "SELECT DISTINCT 'api::' || url AS id, url AS name, 'API_ENDPOINT' AS node_type, 'http' AS language FROM ra WHERE hit IS NULL", recursive=REACT)
def _(g):
    return _react(g)[1]


SHORT = "CASE WHEN line_no % 2 = 0 THEN path ELSE regexp_replace(path, '^[^/]*/', '') END"
NOTED = f"kn AS (SELECT id, name, {SHORT} AS path, 'Kept in ' || language AS docstring, CAST(NULL AS VARCHAR) AS business_domain, CASE WHEN is_exported THEN kind ELSE '' END AS service, CASE WHEN is_async THEN 'async, ' || kind END AS tags FROM cs), aq AS (SELECT DISTINCT '/srv/' || path AS source, name FROM cs), hi AS (SELECT source, aq.name, min(id) AS id FROM aq JOIN kn ON kn.name = aq.name AND ends_with(source, kn.path) GROUP BY ALL)"


@on_code("rel_43_comment_context", "SELECT source, name, array_to_string(list_concat(list_filter(['Documentation: ' || docstring, CASE WHEN business_domain <> '' THEN 'Business Domain: ' || business_domain END, CASE WHEN service <> '' THEN 'Service: ' || service END, CASE WHEN tags <> '' THEN 'Tags: ' || tags END], lambda x: x IS NOT NULL), coalesce((SELECT list('→ ' || relation || ': ' || t.name ORDER BY relation, to_id) FROM ce JOIN kn t ON t.id = to_id WHERE ce.from_id = hi.id), []))[1:10], chr(10)) AS context FROM hi JOIN (SELECT * EXCLUDE (name) FROM kn) USING (id)", recursive=NOTED)
def _(g):
    code = g.symbols.where("node_type <> 'SQL_TABLE'")
    known = code.select(
        "id", "name", F.expr(SHORT).alias("path"), F.concat(F.lit("Kept in "), "language").alias("docstring"), F.lit(None).cast("string").alias("business_domain"),
        F.when(F.col("is_exported"), F.col("kind")).otherwise("").alias("service"), F.when(F.col("is_async"), F.concat(F.lit("async, "), "kind")).alias("tags"),
    )
    return lnk.comment_context(Graph(known, g.edges), code.select(F.concat(F.lit("/srv/"), "path").alias("source"), "name"))


@on_code("rel_42_store_context", "SELECT id, bool_or(up.at IN (SELECT path FROM f WHERE regexp_matches(text, 'db\\.\\w+\\.'))) OR contains(lower(any_value(name)), 'mongodb') AS inside FROM up GROUP BY id", recursive="pa AS (SELECT cn.id, name, (SELECT min(from_id) FROM ce WHERE relation = 'CONTAINS' AND to_id = cn.id) AS parent_id FROM cn), up AS (SELECT id, name, id AS at, 0 AS depth FROM pa UNION ALL SELECT up.id, up.name, pa.parent_id, depth + 1 FROM up JOIN pa ON pa.id = up.at WHERE pa.parent_id IS NOT NULL AND depth < 4)")
def _(g):
    parent = g.edges.where("relation = 'CONTAINS'").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("parent_id"))
    marked = g.files.where(F.col("text").rlike(r"db\.\w+\.")).select(F.col("path").alias("id"))
    return lnk.in_context(g.nodes.join(parent, "id", "left"), marked)


FED = """ar AS (SELECT us.path, us.t AS artifact, relation FROM us), mk AS (SELECT artifact, min(path) AS component FROM ar WHERE relation = 'WRITES_TABLE' GROUP BY artifact), cp AS (SELECT path AS component, 'Keeper of ' || regexp_extract(path, '^(\\w+/\\w+)', 1) AS name FROM f WHERE language = 'python')"""


@on_code("rel_34_artifact_flows", "SELECT DISTINCT a.artifact AS source, b.artifact AS sink, coalesce(pc.name, a.component || ' Service') AS producer_service, coalesce(cc2.name, b.component || ' Service') AS consumer_service FROM mk a JOIN ar c ON c.artifact = a.artifact AND c.relation = 'QUERIES_TABLE' JOIN mk b ON b.component = c.path AND b.artifact <> a.artifact LEFT JOIN cp pc ON pc.component = a.component LEFT JOIN cp cc2 ON cc2.component = b.component", recursive=FED)
def _(g):
    used = g.scanned.select("path", F.inline("uses")).where("t <> 'if'").withColumnRenamed("t", "artifact")
    side = lambda r: used.where(F.col("relation") == r).select("artifact", F.col("path").alias("component"))
    kept = g.files.where("language = 'python'").select(F.col("path").alias("component"), F.concat(F.lit("Keeper of "), F.regexp_extract("path", r"^(\w+/\w+)", 1)).alias("name"))
    return lnk.artifact_flows(side("WRITES_TABLE"), side("QUERIES_TABLE"), kept)


# --- contexts cut to a budget ------------------------------------------------------------
def _weight(lists: str) -> str:
    text = f"array_to_string({lists}, ' ')"
    return f"(floor(len(regexp_extract_all({text}, '\\S+')) * 1.3) + floor(len(regexp_extract_all({text}, '{fn.SPECIAL}')) * 0.3))"


def _halvings(n: str, first: str, least: int) -> str:
    """The sizes that halving goes through: all of n, then first, first // 2 and so on while more than ``least``."""
    return f"list_concat([{n}], list_filter(list_transform(range(0, 30), lambda i: CAST({first} AS BIGINT) // CAST(2 ** i AS BIGINT)), lambda k: k > {least}))"


CONTEXTS = """ed AS (SELECT from_id AS id, to_id AS other, 0 AS way, relation FROM ce UNION ALL SELECT to_id, from_id, 1, relation FROM ce),
nb AS (SELECT id, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS k FROM (SELECT DISTINCT id, other FROM ed WHERE id <> other)) WHERE k <= 80),
cx AS (SELECT cs.id, [kind || ' ' || qualified] AS head, coalesce((SELECT list('[' || node_type || '] ' || name ORDER BY cn.id) FROM nb JOIN cn ON cn.id = nb.other WHERE nb.id = cs.id), []) AS neighbours,
  coalesce((SELECT list(['-> ', '<- '][way + 1] || relation || ': ' || ed.other ORDER BY way, relation, ed.other) FROM ed JOIN nb USING (id, other) WHERE ed.id = cs.id), []) AS edges,
  coalesce((SELECT list(name || '(' || params || ')' ORDER BY line_no) FROM (SELECT path, line_no, name, params, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM cs r WHERE kind IN ('FUNCTION', 'METHOD')) r WHERE r.path = cs.path AND k <= 8 AND r.line_no <> cs.line_no), []) AS related,
  (SELECT list(line ORDER BY l0.line_no) FROM l0 WHERE l0.path = cs.path AND l0.line_no BETWEEN cs.line_no AND cs.end_line) AS source FROM cs)"""
_N, _E = "list_concat(head, neighbours[1:k], edges, related, source)", "list_concat(head, neighbours, edges[1:k], related, source)"
_ALL = "list_concat(head, neighbours, edges, related, source)"
COMPRESSED = f"""{CONTEXTS},
x1 AS (SELECT * REPLACE (neighbours[1:coalesce(list_filter(s, lambda k: {_weight(_N)} <= 150)[1], s[-1])] AS neighbours) FROM (SELECT *, {_halvings("len(neighbours)", "greatest(5, len(neighbours) // 2)", 3)} AS s FROM cx)),
x2 AS (SELECT * EXCLUDE (s) REPLACE (edges[1:coalesce(list_filter(t, lambda k: {_weight(_E)} <= 150)[1], t[-1])] AS edges) FROM (SELECT *, {_halvings("len(edges)", "greatest(10, len(edges) // 2)", 5)} AS t FROM x1)),
x3 AS (SELECT * REPLACE (CASE WHEN {_weight(_ALL)} > 150 THEN related[1:3] ELSE related END AS related) FROM x2),
x4 AS (SELECT *, {_weight(_ALL)} > 150 AND len(source) > 0 AS truncated FROM x3),
x5 AS (SELECT * REPLACE (CASE WHEN truncated THEN list_append(source[1:greatest(20, len(source) // 2)], '... [truncated]') ELSE source END AS source) FROM x4)"""


def contexts(g) -> DataFrame:
    """id and the sections of each declaration's context: head, neighbours (80 at most, by id), edges to them, related functions of the file (of the first eight), source.

    All but neighbours and edges lies in the file's row, so these come to it by path, once a file, and no source is shuffled for each declaration.
    A declaration's id is its path, two colons and a name without colons: what is before the last two colons is the path.
    """
    e = g.edges
    ends = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit(0).alias("way"), "relation").unionByName(e.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit(1).alias("way"), "relation"))
    ends = ends.where("id <> other and contains(id, '::')")
    for made in ("api", "table"):  # endpoints and tables are nobody's declarations, unless a file is named so
        if g.scanned.where((F.col("path") == made) | F.startswith("path", F.lit(f"{made}::"))).select("path").isEmpty():
            ends = ends.where(~F.startswith("id", F.lit(f"{made}::")))
    near = ends.withColumn("k", F.dense_rank().over(Window.partitionBy("id").orderBy("other"))).where("k <= 80").drop("k")
    labels = g.nodes.groupBy(F.col("id").alias("other")).agg(F.array_sort(F.collect_list(F.concat(F.lit("["), "node_type", F.lit("] "), "name"))).alias("labels"))
    path = F.expr("left(id, length(id) - length(substring_index(id, '::', -1)) - 2)")
    near = near.join(labels, "other", "left").withColumn("path", path).repartition("path")
    links = F.transform(F.array_sort(F.collect_list(F.struct("way", "relation", "other"))), lambda s: F.concat(F.when(s["way"] == 0, "-> ").otherwise("<- "), s["relation"], F.lit(": "), s["other"]))
    names = F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("other", F.coalesce("labels", F.array().cast("array<string>")).alias("labels")))), lambda s: s["labels"]))
    of_file = near.groupBy("path", "id").agg(names.alias("neighbours"), links.alias("edges")).groupBy("path").agg(F.collect_list(F.struct("id", "neighbours", "edges")).alias("near"))
    code = F.filter("declared", lambda d: d["node_type"] != "SQL_TABLE")
    first = F.slice(F.filter("code", lambda d: d["kind"].isin("FUNCTION", "METHOD")), 1, 8)  # in the order of lines
    x = g.scanned.select("path", "text", code.alias("code")).where(F.size("code") > 0).join(of_file, "path", "left")
    x = x.select("near", F.split("text", "\n").alias("lines"), "code", F.transform(first, lambda d: F.struct(d["line_no"].alias("line_no"), F.concat(d["name"], F.lit("("), d["params"], F.lit(")")).alias("t"))).alias("first"))
    x = x.withColumn("lines", cmp.items(F.col("lines"))).select("near", "lines", "first", F.explode("code").alias("d"))
    x = x.withColumn("n", F.get(F.filter("near", lambda n: n["id"] == F.col("d.id")), F.lit(0)))
    related = F.transform(F.filter("first", lambda r: r["line_no"] != F.col("d.line_no")), lambda r: r["t"])
    head = F.array(F.concat("d.kind", F.lit(" "), "d.qualified"))
    told = {"head": head, "neighbours": F.col("n.neighbours"), "edges": F.col("n.edges"), "related": related}
    source = F.slice("lines", F.col("d.line_no"), F.col("d.end_line") - F.col("d.line_no") + 1)
    return x.select(F.col("d.id").alias("id"), *(cmp.items(c).alias(k) for k, c in told.items()), source.alias("source"))


def _texts(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda i: i["text"]), "\n").alias(c)


@on_code("ctx_11_compressed", f"SELECT id, array_to_string(neighbours, chr(10)) AS neighbours, array_to_string(edges, chr(10)) AS edges, array_to_string(related, chr(10)) AS related, array_to_string(source, chr(10)) AS source, truncated, CAST({_weight(_ALL)} AS BIGINT) AS tokens FROM x5", recursive=COMPRESSED)
def _(g):
    return cmp.compressed(contexts(g), 150).select("id", *(_texts(c) for c in ("neighbours", "edges", "related", "source")), "truncated", "tokens")


def _trims(budget: int) -> str:
    """One CTE a section: the first of all, half, a quarter and so on that fits, else none."""
    names = {"semantic_neighbors": "neighbours", "relationships": "edges", "related_functions": "related", "target": "head", "source_code": "source"}
    out, before, all_ = [], "cx", [f"coalesce({c}, [])" for c in ("head", "neighbours", "edges", "related", "source")]
    for i, c in enumerate(names.values()):
        whole = f"list_concat({', '.join(all_)})"
        tried = f"list_concat({', '.join(x.replace(c, c + '[1:k]') for x in all_)})"
        sizes = f"CASE WHEN len({c}) > 2 THEN list_filter(list_transform(range(0, 30), lambda i: len({c}) // CAST(2 ** i AS BIGINT)), lambda k: k > 0) ELSE [len({c})] END"
        out.append(f"t{i} AS (SELECT * REPLACE (CASE WHEN {_weight(whole)} <= {budget} THEN {c} WHEN len(list_filter({sizes}, lambda k: {_weight(tried)} <= {budget})) > 0 THEN {c}[1:list_filter({sizes}, lambda k: {_weight(tried)} <= {budget})[1]] END AS {c}) FROM {before})")
        before = f"t{i}"
    return f"{CONTEXTS}, {', '.join(out)}"


@on_code("ctx_12_trimmed", "SELECT id, array_to_string(neighbours, chr(10)) AS semantic_neighbors, array_to_string(edges, chr(10)) AS relationships, array_to_string(related, chr(10)) AS related_functions, array_to_string(head, chr(10)) AS target, array_to_string(source, chr(10)) AS source_code, CAST(" + _weight("list_concat(" + ", ".join(f"coalesce({c}, [])" for c in ("head", "neighbours", "edges", "related", "source")) + ")") + " AS BIGINT) AS tokens FROM t4", recursive=_trims(60))
def _(g):
    names = {"neighbours": "semantic_neighbors", "edges": "relationships", "related": "related_functions", "head": "target", "source": "source_code"}
    return cmp.trimmed(contexts(g).withColumnsRenamed(names), 60).select("id", *(_texts(c) for c in names.values()), "tokens")


# --- complexity and relevance --------------------------------------------------------------
MEASURED = """ms AS (SELECT cn.id, cn.node_type, coalesce(regexp_extract(cn.path, '^(\\w+/\\w+)', 1), '') AS service, coalesce(split_part(cn.path, '/', 1), '') AS domain, least(coalesce(length(s.text), 0), 500) AS body_chars, coalesce(s.n, 0) AS n_params FROM cn
  LEFT JOIN (SELECT sy.id, min(CASE WHEN params = '' THEN 0 ELSE len(string_split(params, ',')) END) AS n, min(t.text) AS text FROM sy JOIN (SELECT sy.id, string_agg(line, chr(10) ORDER BY l0.line_no) AS text FROM sy JOIN l0 ON l0.path = sy.path AND l0.line_no BETWEEN sy.line_no AND sy.end_line GROUP BY sy.id, sy.line_no) t ON t.id = sy.id GROUP BY sy.id) s USING (id)),
dg AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM ce UNION ALL SELECT to_id FROM ce) GROUP BY id)"""


def measured(g) -> DataFrame:
    """id, node_type, service and domain (from the path), body_chars (500 at most, as previews are cut) and n_params of the graph's nodes."""
    body = lambda d: F.array_join(F.slice(F.split("text", "\n"), d["line_no"], d["end_line"] - d["line_no"] + 1), "\n")
    n = lambda d: F.when(d["params"] == "", 0).otherwise(F.size(F.split(d["params"], ",")))
    # an id begins with its path, so equal ids are in one row; only those carry a body on, to take the least
    many = lambda d: F.size(F.filter("declared", lambda o: o["id"] == d["id"])) > 1
    told = lambda d: F.struct(d["id"].alias("id"), F.when(many(d), body(d)).alias("text"), F.length(body(d)).alias("chars"), n(d).alias("n_params"))
    s = g.scanned.select(F.inline(F.transform("declared", told))).groupBy("id").agg(F.min_by("chars", F.coalesce("text", F.lit(""))).alias("chars"), F.min("n_params").alias("n_params"))
    x = g.nodes.join(s, "id", "left")
    return x.select("id", "node_type", F.coalesce(F.regexp_extract("path", r"^(\w+/\w+)", 1), F.lit("")).alias("service"), F.coalesce(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("")).alias("domain"), F.least(F.coalesce("chars", F.lit(0)), F.lit(500)).alias("body_chars"), F.coalesce("n_params", F.lit(0)).alias("n_params"))


@on_code("agg_20_code_complexity", "SELECT ms.id, round(least(0.35::DOUBLE * coalesce(degree, 0) / (SELECT max(degree) FROM dg) + 0.25::DOUBLE * body_chars / (SELECT greatest(max(body_chars), 1) FROM ms) + 0.15::DOUBLE * n_params / (SELECT greatest(max(n_params), 1) FROM ms) + CASE WHEN EXISTS (SELECT 1 FROM ce JOIN ms t ON t.id = to_id WHERE from_id = ms.id AND t.service <> '' AND ms.service <> '' AND t.service <> ms.service) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 1), 8) AS complexity FROM ms LEFT JOIN dg USING (id)", recursive=MEASURED)
def _(g):
    return agg.code_complexity(measured(g), g.edges, digits=8)  # fewer digits would meet exact halves, which engines round either way


NEAR_API = f"""{WALKS}, {MEASURED}, fw AS (SELECT DISTINCT unnest(path) AS id FROM ch),
st2 AS (SELECT from_id AS a, to_id AS b FROM ce WHERE relation IN ('INVOKES', 'CALLS', 'QUERIES_TABLE', 'WRITES_TABLE')), h1 AS (SELECT DISTINCT a AS seed, b AS id FROM st2 WHERE a LIKE 'api::%'),
h2 AS (SELECT DISTINCT h1.seed, st2.b AS id FROM h1 JOIN st2 ON st2.a = h1.id WHERE NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.id = st2.b) AND st2.b <> h1.seed),
nr AS (SELECT seed, id, 1 AS hop FROM h1 UNION ALL SELECT seed, id, 2 FROM h2),
rk AS (SELECT seed, nr.id, hop, round(0.30 * least(coalesce(degree, 0) / (SELECT max(degree) FROM dg), 1.0) + 0.25 / hop + 0.20 * CASE WHEN nr.id IN (SELECT id FROM fw) THEN 1.0 WHEN m.domain <> '' THEN 0.5 ELSE 0 END
  + 0.15 * CASE m.node_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in ctx.CODE_WEIGHT.items())} ELSE 0.4 END + 0.10 * CASE WHEN o.service <> '' AND m.service = o.service THEN 1.0 WHEN o.domain <> '' AND m.domain = o.domain THEN 0.5 ELSE 0 END, 6) AS relevance
  FROM nr JOIN ms m ON m.id = nr.id JOIN ms o ON o.id = nr.seed LEFT JOIN dg ON dg.id = nr.id)"""


def near_endpoints(g) -> DataFrame:
    """seed, id, hop, relevance of what each endpoint reaches in two hops."""
    follow = g.edges.where("relation in ('INVOKES', 'CALLS', 'QUERIES_TABLE', 'WRITES_TABLE')")
    near = k_hop(Graph(g.nodes, follow), g.nodes.where("node_type = 'API_ENDPOINT'"), 2, "out")
    d = agg.degrees(Graph(g.nodes, g.edges)).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    top = d.agg(F.max("degree").alias("m"))
    nodes = measured(g).join(d, "id").crossJoin(top).withColumn("centrality", F.col("degree") / F.col("m"))  # one row
    flows = lin.sql_lineage(g).select(F.explode("path").alias("id"))
    return ctx.relevance(near.select("seed", "id", "hop"), nodes, flows)


@on_code("ctx_08_code_rank", "SELECT * FROM rk", recursive=NEAR_API)
def _(g):
    return near_endpoints(g)


@on_code("ctx_09_code_top", "SELECT seed, id, relevance, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY relevance DESC, id) AS place FROM rk) WHERE place <= 3", recursive=NEAR_API)
def _(g):
    return ctx.top_of_each(near_endpoints(g), 3)


def _asked(rounds: int) -> str:
    say = "['{a} → {b}: ' || c.name || '()', '{b} → {a}: return result']".replace("{a}", "' || pend[1].actor || '").replace("{b}", "' || c.actor || '").replace("['' || ", "[").replace(", '' || ", ", ")
    out = []
    for i in range(1, rounds + 1):
        out.append(f"""h{i} AS (SELECT *, len(steps) < 6 AND len(pend) > 0 AS going FROM (SELECT *, list_filter(queue, lambda x: NOT list_contains(seen, x.id)) AS pend FROM q{i - 1})),
q{i} AS (SELECT name, class, CASE WHEN going THEN list_concat(pend[2:], coalesce(list_transform(cl, lambda c: {{'id': c.to_id, 'actor': c.actor}}), [])) ELSE pend END AS queue, CASE WHEN going THEN list_append(seen, pend[1].id) ELSE seen END AS seen,
  CASE WHEN going THEN list_concat(steps, coalesce(flatten(list_transform(cl, lambda c: {say})), [])) ELSE steps END AS steps FROM h{i} LEFT JOIN cq ON cq.from_id = pend[1].id)""")
    return ", ".join(out)


LIBRARY = f"""ic AS (SELECT e.from_id, e.to_id, k.name AS class FROM ce e JOIN cn k ON k.id = e.from_id AND k.node_type = 'CLASS' WHERE relation = 'CONTAINS'),
q0 AS (SELECT class || '.' || m.name || '()' AS name, class, [{{'id': m.id, 'actor': class}}] AS queue, CAST([] AS VARCHAR[]) AS seen, ['Caller → ' || class || ': ' || m.name || '(input)'] AS steps FROM ic JOIN cn m ON m.id = to_id AND m.node_type IN ('METHOD', 'FUNCTION') AND NOT starts_with(m.name, '_')
  ORDER BY {" + ".join(f"CASE WHEN contains(lower(m.name), '{w}') THEN 3 ELSE 0 END" for w in lin.INTERESTING)} DESC, from_id, to_id LIMIT 4),
cq AS (SELECT e.from_id, list({{'to_id': e.to_id, 'name': n.name, 'actor': coalesce(a.class, 'System')}} ORDER BY e.to_id, e.relation) AS cl FROM (SELECT DISTINCT from_id, to_id, relation FROM ce WHERE relation IN ('CALLS', 'CALLS_API')) e JOIN cn n ON n.id = e.to_id LEFT JOIN (SELECT to_id, arg_min(class, from_id) AS class FROM ic GROUP BY to_id) a ON a.to_id = e.to_id GROUP BY e.from_id),
{_asked(5)}"""


@on_code("grf_19_library_flows", "SELECT name, array_to_string(CASE WHEN len(list_filter(steps, lambda x: contains(x, '→ Caller'))) > 0 THEN steps ELSE list_append(steps, class || ' → Caller: return result') END, chr(10)) AS steps FROM q5", recursive=LIBRARY)
def _(g):
    return lin.library_flows(g).select("name", F.array_join("steps", "\n").alias("steps"))


@on_code("doc_24_contents", "SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) - 1 AS INTEGER) AS number, kind || ' ' || name AS title, replace(regexp_replace(lower(kind || ' ' || name), '[^a-z0-9 -]', '', 'g'), ' ', '-') AS anchor FROM sy")
def _(g):
    said = F.transform("declared", lambda d: F.concat(F.lit("\n## "), d["kind"], F.lit(" "), d["name"]))  # in the order of lines
    pages = g.scanned.where(F.size("declared") > 0).select("path", F.concat(F.lit("# "), "path", F.array_join(said, "")).alias("text"))
    return out.contents(pages, "path")
