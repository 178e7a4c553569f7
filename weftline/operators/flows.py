"""Flows traced through the graph, longest paths, target resolution, virtual nodes and change scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..plans.graph import Graph
from ..session import written as cut
from . import aggregates as agg
from . import renderers as out
from .relational import neighbours

#: Types in which a function is looked up, in order.
CALLABLE = ["FUNCTION", "ASYNC_DEF", "METHOD"]
#: Words in the name of a call's target that tell an error path.
ERROR_WORDS = "error|exception|catch|handler|fallback"


def _earliest(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each seed, numbered as step; tasks drop later rows before the shuffle."""
    return df.withColumn("step", F.row_number().over(Window.partitionBy("seed").orderBy(*order)).cast("long")).where(F.col("step") <= most)


def trace(g: Graph, start: DataFrame, relations: list[str], depth: int, most: int | None = None, direction: str = "out", closed: DataFrame | None = None) -> DataFrame:
    """seed, id, depth: nodes found from each row of ``start`` (seed, id, depth) breadth-first, those of ``start`` included.

    With ``most``, only the first so many nodes of each seed by (depth, id), numbered as step. A level keeps no more than that
    of a seed, which changes nothing: where it drops a node, later levels aren't reached. ``closed`` holds rows that are
    in the result but not followed.
    """
    step = cut(neighbours(Graph(g.nodes, g.edges.where(F.col("relation").isin(*relations))), direction).distinct())
    reached = frontier = cut(start.select("seed", "id", "depth").distinct())
    if closed is not None:
        reached = frontier.unionByName(cut(closed.select("seed", "id", "depth")))
    for _ in range(depth):
        new = frontier.join(step, "id").select("seed", F.col("neighbour").alias("id"), F.col("depth") + 1).toDF("seed", "id", "depth")
        new = new.distinct().join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = cut(new if most is None else _earliest(new, ["id"], most).drop("step"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached if most is None else _earliest(reached, ["depth", "id"], most)


def seeds(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))


def endpoint_flows(g: Graph, endpoints: DataFrame, handled_by: list[str], relations: list[str], depth: int = 10) -> DataFrame:
    """seed, id, depth: an endpoint (0), those that handle it (1) and what they reach; endpoints without a handler have no flow."""
    handlers = g.edges.where(F.col("relation").isin(*handled_by)).join(endpoints.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    handlers = handlers.select(F.col("to_id").alias("seed"), F.col("from_id").alias("id")).distinct()
    own = handlers.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")).distinct()
    return trace(g, handlers.where("seed <> id").withColumn("depth", F.lit(1)), relations, depth, closed=own)


def roots(g: Graph, node_types: list[str], least_out: int = 2) -> DataFrame:
    """Nodes of some types that no edge leads to and at least ``least_out`` lead away from."""
    away = g.edges.groupBy(F.col("from_id").alias("id")).count().where(F.col("count") >= least_out)
    found = g.nodes.where(F.col("node_type").isin(*node_types)).join(away, "id", "left_semi")
    return found.join(g.edges.select(F.col("to_id").alias("id")), "id", "left_anti")


def named_steps(g: Graph, chain: DataFrame, by: str) -> DataFrame:
    """seed, n, steps: the names of a chain (seed, id, step) in order."""
    named = chain.join(g.nodes.select("id", "name"), "id").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("step", "name"))).alias("l"))
    return named.select("seed", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["name"]), by).alias("steps"))


def longest_paths(edges: DataFrame, most: int = 7) -> DataFrame:
    """id, length, path: the longest path (of equals the least text) that ends at each node of an acyclic graph (a, b), of up to ``most`` nodes.

    A round holds one path a node, so that the number of paths doesn't matter.
    """
    step = cut(edges.select("a", "b").where("a <> b").distinct())
    layer = step.select(F.col("a").alias("id")).unionAll(step.select("b")).distinct().select("id", F.lit(1).alias("length"), F.col("id").alias("path"))
    layers = [layer]
    for n in range(2, most + 1):
        longer = layer.join(step, F.col("id") == F.col("a")).groupBy("b").agg(F.min(F.concat("path", F.lit(">"), "b")).alias("path"))
        layer = cut(longer.select(F.col("b").alias("id"), F.lit(n).alias("length"), "path"))
        if layer.isEmpty():
            break
        layers.append(layer)
    return reduce(DataFrame.unionByName, layers).groupBy("id").agg(F.max("length").alias("length"), F.max_by("path", "length").alias("path"))


def resolve(g: Graph, queries: DataFrame) -> DataFrame:
    """query, id, how: the node that each text (column query) names, by id, name, service or domain, in this order; the least id of equals.

    Names but ids are compared in lower case. Keys are reduced to their least id before the join, so a common service costs one row.
    """
    n, low = g.nodes, lambda c: F.lower(c)
    keys = [n.select(F.col("id").alias("k"), F.lit(i).alias("r"), "id") if c == "id" else n.select(low(c).alias("k"), F.lit(i).alias("r"), "id") for i, c in enumerate(["id", "name", "service", "domain"])]
    least = reduce(DataFrame.unionByName, keys).where("k is not null").groupBy("k", "r").agg(F.min("id").alias("id"))
    asked = queries.select("query").distinct()
    tried = asked.select("query", F.col("query").alias("k"), F.lit(True).alias("exact")).unionByName(asked.select("query", low("query").alias("k"), F.lit(False).alias("exact")))
    hit = tried.join(least, "k").where(F.col("exact") == (F.col("r") == 0)).groupBy("query").agg(F.min_by("id", "r").alias("id"), F.min("r").alias("r"))
    how = rules.first_of([(F.col("r") == i, F.lit(c)) for i, c in enumerate(["id", "name", "service", "domain"])], F.lit(None))
    return asked.join(hit, "query", "left").select("query", "id", how.alias("how"))


def relation_sections(g: Graph) -> DataFrame:
    """id, direction, relation, n, first_name: what a node's edges of each relation lead to and come from."""
    ends = g.edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "relation", F.lit("out").alias("direction"))
    ends = ends.unionByName(g.edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "relation", F.lit("in").alias("direction")))
    named = ends.join(g.nodes.select(F.col("id").alias("other"), "name"), "other")
    return named.groupBy("id", "direction", "relation").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def positions(g: Graph) -> DataFrame:
    """id, n_before, n_after, position: entry (nothing before), exit (nothing after), inner or alone."""
    ends = g.edges.select(F.col("from_id").alias("id"), F.lit(0).alias("b"), F.lit(1).alias("a")).unionByName(g.edges.select(F.col("to_id").alias("id"), F.lit(1).alias("b"), F.lit(0).alias("a")))
    n = g.nodes.select("id").join(ends.groupBy("id").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "id", "left").select("id", F.coalesce("b", F.lit(0)).alias("n_before"), F.coalesce("a", F.lit(0)).alias("n_after"))
    b, a = F.col("n_before") > 0, F.col("n_after") > 0
    return n.withColumn("position", rules.first_of([(b & a, F.lit("inner")), (a, F.lit("entry")), (b, F.lit("exit"))], F.lit("alone")))


def call_edges(sym: DataFrame, calls: DataFrame) -> DataFrame:
    """from_key, to_key, relation of calls (source, caller, target, callee) between symbols.

    Both ends are looked up as function, async function and method, in this order; if only the caller is found, file depends on file.
    """
    order = F.array_position(F.array(*map(F.lit, CALLABLE)), F.col("category"))
    known = sym.where(F.col("category").isin(*CALLABLE)).groupBy("path", "name").agg(F.min_by("category", order).alias("t"))
    ends = calls
    for path, name, key in (("source", "caller", "c"), ("target", "callee", "d")):
        ends = ends.join(known.select(F.col("path").alias(path), F.col("name").alias(name), F.concat_ws("::", "t", "path", "name").alias(key)), [path, name], "left")
    both = F.col("d").isNotNull()
    one = lambda x, y: F.when(both, F.col(x)).otherwise(F.col(y))
    return ends.where("c is not null").select(one("c", "source").alias("from_key"), one("d", "target").alias("to_key"), F.when(both, "CALLS").otherwise("DEPENDS_ON").alias("relation")).distinct()


def control_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """from_id, to_id, relation: calls of nodes (id, name, body) whose body branches, and those from a try to what looks like an error path."""
    body = F.lower("body")
    has = lambda *words: reduce(lambda x, y: x | y, (F.contains(body, F.lit(w)) for w in words))
    tries = has("try ", "try:", "try{")
    flags = nodes.select(F.col("id").alias("from_id"), (has("if ", "if(", "switch ", "match ") | tries).alias("branches"), tries.alias("tries")).where("branches")
    ends = calls.select("from_id", "to_id").join(flags, "from_id").join(nodes.select(F.col("id").alias("to_id"), F.lower("name").rlike(ERROR_WORDS).alias("error")), "to_id")
    back = F.when(F.col("tries") & F.col("error"), F.array(F.lit("CONTROL_FLOW"), F.lit("RETURNS_TO"))).otherwise(F.array(F.lit("CONTROL_FLOW")))
    return ends.where("from_id <> to_id").select("from_id", "to_id", F.explode(back).alias("relation")).distinct()


def virtual_edges(g: Graph) -> DataFrame:
    """from_id, to_id, relation: each node to the node of its service and to that of the flow of its domain."""
    to = [("service", "service_cluster__", "BELONGS_TO_SERVICE"), ("domain", "business_flow__", "PARTICIPATES_IN_FLOW")]
    parts = [g.nodes.where(F.col(c).isNotNull()).select(F.col("id").alias("from_id"), F.concat(F.lit(p), c).alias("to_id"), F.lit(r).alias("relation")) for c, p, r in to]
    return reduce(DataFrame.unionByName, parts)


def stage_name(raw, capabilities: list[str]):
    """The first capability that holds ``raw`` or that ``raw`` holds, in any case, else ``raw`` as a title."""
    low = F.lower(raw)
    hits = F.filter(F.array(*map(F.lit, capabilities)), lambda x: F.contains(low, F.lower(x)) | F.contains(F.lower(x), low))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), rules.title(raw))


def change_script(nodes: DataFrame, edges: DataFrame, gone: DataFrame, size: int = 500) -> DataFrame:
    """kind, batch, line: statements that add nodes and edges, ``size`` to a transaction, and those that remove partitions (column partition)."""
    id_, type_ = out.quoted(F.col("id")), F.col("node_type")
    node = F.concat(F.lit("MERGE (n:"), type_, F.lit(" {id: "), id_, F.lit("}) SET n.name = "), out.quoted(F.substring("name", 1, 200)), F.lit(", n.node_type = "), out.quoted(type_), F.lit(";"))
    added = agg.chunks(nodes.select("id", node.alias("line")), ["id"], size).select(F.lit("node").alias("kind"), "batch", "line")
    linked = agg.chunks(out.edge_statements(edges).select("from_id", "to_id", "line"), ["from_id", "to_id"], size).select(F.lit("edge").alias("kind"), "batch", "line")
    drop = F.concat(F.lit("MATCH (n) WHERE n.partition_id = "), out.quoted(F.col("partition")), F.lit(" DETACH DELETE n;"))
    return added.unionByName(linked).unionByName(gone.select(F.lit("delete").alias("kind"), F.lit(0).cast("long").alias("batch"), drop.alias("line")))


def message_edges(sym: DataFrame, text) -> DataFrame:
    """from_key, to_key, relation: symbols that publish to a bus, buses that symbols hear, and the pipelines that symbols run."""
    own = F.concat_ws("::", "path", "name")
    found = sym.select(own.alias("own"), "path", "name", F.lower(text).alias("low"), rules.detected(text, rules.BUSES, rules.BUS_NAMES, "EventBus").alias("bus"), rules.detected(text, rules.PIPELINES, rules.PIPELINE_NAMES, "ETL").alias("pipeline"))
    bus, flow = F.concat_ws("::", F.lit("EVENT_BUS"), "bus", "path"), F.concat_ws("::", F.lit("DATA_PIPELINE"), "pipeline", "name")
    edge = lambda a, b, r: F.struct(a.alias("from_key"), b.alias("to_key"), F.lit(r).alias("relation"))
    on = F.col("bus").isNotNull()
    edges = [F.when(on & F.col("low").rlike(rules.PUBLISHES), edge(F.col("own"), bus, "PUBLISHES_TO")), F.when(on & F.col("low").rlike(rules.SUBSCRIBES), edge(bus, F.col("own"), "SUBSCRIBES_FROM")), F.when(F.col("pipeline").isNotNull(), edge(F.col("own"), flow, "CALLS"))]
    return found.select(F.explode(F.array_compact(F.array(*edges))).alias("e")).select("e.*").distinct()


def sequence_steps(g: Graph, start: DataFrame, verbs: dict[str, str], depth: int = 4, most: int = 12) -> DataFrame:
    """seed, number, source, verb, target: the first ``most`` nodes after each start by (depth, id), each told from its least parent of the level before."""
    found = cut(trace(g, start, list(verbs), depth, most=most + 1))
    up = found.select("seed", F.col("id").alias("from_id"), (F.col("depth") + 1).alias("depth"))
    e = g.edges.where(F.col("relation").isin(*verbs)).select("from_id", F.col("to_id").alias("id"), "relation")
    told = found.where("depth > 0").join(up.join(e, "from_id"), ["seed", "id", "depth"]).groupBy("seed", "id", "step").agg(F.min(F.struct("from_id", "relation")).alias("p"))
    verb = rules.first_of([(F.col("p.relation") == r, F.lit(v)) for r, v in verbs.items()], F.lit(None))
    return told.select("seed", (F.col("step") - 1).alias("number"), F.col("p.from_id").alias("source"), verb.alias("verb"), F.col("id").alias("target"))


def table_links(sym: DataFrame, mentions: str, defines: str) -> DataFrame:
    """path, target, table_name: files whose symbols name a table that another file defines first (of equals the least path).

    The index holds one row a table, so a common table joins each file once.
    """
    def named(pattern: str) -> DataFrame:
        return sym.select("path", F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("t")).select("path", F.lower("t").alias("table_name")).distinct()

    index = named(defines).groupBy("table_name").agg(F.min("path").alias("target"))
    return named(mentions).join(index, "table_name").where("path <> target").select("path", "target", "table_name")
