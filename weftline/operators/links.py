"""Links whose condition is no equality - prefixes, suffixes, chains of parents, shared items - as joins on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..session import written as cut

#: Parts into which the rows of one key are dealt where a key may be hot; the other side has one row a key, repeated for each.
SALTS = 16
# What a name tells of a document store, and types that a component's symbol may have.
STORE_WORDS = ["pymongo", "mongoose", "motor", "spring-data-mongodb", "mongodb", "mongoclient", "mongoengine"]


def trimmed(c: Column) -> Column:
    """Without slashes at the end."""
    return F.regexp_replace(c, "/+$", "")


def _beginnings(c: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda k: F.substring(c, 1, k)))


def first_prefix_match(calls: DataFrame, routes: DataFrame, other_file: bool = True) -> DataFrame:
    """path, url, target, pattern: for each call (path, url) the first route (pattern, path) by pattern that equals it, begins it or that it begins, slashes at the end apart.

    With ``other_file`` a route of the call's own file doesn't count. Both directions are joins on equal texts: the beginnings of
    a url meet whole routes, a whole url meets the beginnings of routes. Either side of routes holds, for a text, the first route and the
    first one of another file, which is all that a call can need. A url's beginnings are salted, for all urls share some.
    """
    r = routes.groupBy("pattern").agg(F.max("path").alias("target")).withColumn("r", trimmed(F.col("pattern")))

    def two_best(keyed: DataFrame) -> DataFrame:
        """k, best: the first pattern of each of the two targets that come first."""
        one = keyed.groupBy("k", "target").agg(F.min("pattern").alias("pattern"))
        w = Window.partitionBy("k").orderBy("pattern")
        two = one.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
        return two.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pattern", "target"))).alias("best"))

    whole = two_best(r.select(F.col("r").alias("k"), "pattern", "target")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    begun = two_best(r.select(_beginnings(F.col("r")).alias("k"), "pattern", "target"))
    urls = cut(calls.select("url").distinct().withColumn("u", trimmed(F.col("url"))))
    salt = F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")
    longer = urls.select("url", _beginnings(F.col("u")).alias("k"), salt.alias("salt")).join(whole, ["k", "salt"]).select("url", "best")
    shorter = urls.select("url", F.col("u").alias("k")).join(begun, "k").select("url", "best")
    met = longer.unionByName(shorter).select("url", F.explode("best").alias("b")).select("url", "b.*")
    two = two_best(met.withColumnRenamed("url", "k")).withColumnRenamed("k", "url")
    left = F.filter("best", lambda b: b["target"] != F.col("path")) if other_file else F.col("best")
    hit = calls.select("path", "url").distinct().join(two, "url").withColumn("m", F.get(left, F.lit(0)))
    return hit.where("m is not null").select("path", "url", "m.target", "m.pattern")


def react_links(symbols: DataFrame, nodes: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of front-end files, and the endpoint nodes that they ask for and the graph doesn't have, in agreement.

    ``matches`` (path, owner, kind, name) holds hooks, elements and calls (urls) with the declaration around them. They hang on the component or
    class of that name in the file, else on the file. A call links the first endpoint by name that fits its url either way, else a new endpoint.
    """
    comp = nodes.where("node_type in ('REACT_COMPONENT', 'CLASS')").groupBy("path", F.col("name").alias("owner")).agg(F.min_by("id", F.col("node_type") == "CLASS").alias("own"))
    m = cut(matches.join(comp, ["path", "owner"], "left").select("path", "kind", "name", F.coalesce("own", "path").alias("from_id")).distinct())
    named = lambda t, k: nodes.where(F.col("node_type") == t).groupBy("name").agg(F.max("id").alias(k))  # noqa: E731  the last of equal names
    hooks = m.where("kind = 'hook'").join(named("REACT_HOOK", "to_id"), "name").select("from_id", "to_id", F.lit("USES_HOOK").alias("relation"))
    drawn = m.where("kind = 'element'").join(named("REACT_COMPONENT", "to_id"), "name").where("from_id <> to_id").select("from_id", "to_id", F.lit("RENDERS").alias("relation"))
    calls = m.where("kind = 'call'").select("path", F.col("name").alias("url"), "from_id")
    api = nodes.where("node_type = 'API_ENDPOINT'").select(F.col("name").alias("pattern"), F.col("id").alias("path"))
    fits = first_prefix_match(calls, api, other_file=False).select("url", "target").distinct()
    asked = cut(calls.join(fits, "url", "left").withColumn("to_id", F.coalesce("target", F.concat(F.lit("api::"), "url"))))
    called = asked.select("from_id", "to_id", F.lit("CALLS_API").alias("relation"))
    new = asked.where("target is null").select(F.col("to_id").alias("id"), F.col("url").alias("name"), F.lit("API_ENDPOINT").alias("node_type"), F.lit("http").alias("language")).distinct()
    return reduce(DataFrame.unionByName, [hooks, drawn, called]).distinct(), new.join(nodes.select("id"), "id", "left_anti")


def by_path_suffix(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, name, id: for each (source, name) the least node of that name whose path the source ends with.

    A source meets nodes on (name, ending), so the join holds only pairs that fit; a node without a path fits none. A source has only
    endings as long as a path of a node of its name. Both joins are by sort-merge: endings are many more than the files tell, too many to broadcast.
    """
    keys = nodes.where("path is not null and path <> ''").groupBy("name", F.col("path").alias("ending")).agg(F.min("id").alias("id"))
    lengths = keys.groupBy("name").agg(F.collect_set(F.length("ending")).alias("lengths"))
    fits = F.filter("lengths", lambda n: n <= F.length("source"))
    ends = asked.select("source", "name").distinct().join(lengths.hint("merge"), "name").select("source", "name", F.explode(fits).alias("n"))
    ends = ends.select("source", "name", F.expr("right(source, n)").alias("ending"))
    return ends.join(keys.hint("merge"), ["name", "ending"]).groupBy("source", "name").agg(F.min("id").alias("id"))


def comment_context(g: Graph, asked: DataFrame, most: int = 10) -> DataFrame:
    """source, name, context: what the graph tells of a declaration, ``most`` lines at most: docs, domain, service, tags, then its edges by (relation, to_id)."""
    hit = by_path_suffix(asked, g.nodes)
    out = g.edges.join(g.nodes.select(F.col("id").alias("to_id"), F.col("name").alias("target")).hint("merge"), "to_id")
    w = Window.partitionBy("from_id").orderBy("relation", "to_id")
    out = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    told = out.groupBy(F.col("from_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "relation", "target"))), lambda x: F.concat(F.lit("→ "), x["relation"], F.lit(": "), x["target"])).alias("links"))
    text = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), c))
    own = F.array_compact(F.array(text("Documentation: ", "docstring"), text("Business Domain: ", "business_domain"), text("Service: ", "service"), text("Tags: ", "tags")))
    x = hit.hint("merge").join(g.nodes.drop("name"), "id").join(told.hint("merge"), "id", "left")
    lines = F.slice(F.concat(own, F.coalesce("links", F.array().cast("array<string>"))), 1, most)
    return x.select("source", "name", F.array_join(lines, "\n").alias("context"))


def in_context(nodes: DataFrame, marked: DataFrame, words: list[str] = STORE_WORDS) -> DataFrame:
    """id, inside: whether a node's name has one of the words, or it or one of its four nearest ancestors (parent_id) is marked (id).

    Pointers double: after two joins a node knows of itself and three ancestors, a third one adds the fourth.
    """
    own = nodes.select("id", "name", "parent_id").join(marked.select("id", F.lit(True).alias("_m")).distinct(), "id", "left")
    state = cut(own.select("id", "name", F.coalesce("_m", F.lit(False)).alias("own"), F.col("parent_id").alias("up")).withColumn("hit", F.col("own")))
    for _ in range(2):
        above = state.select(F.col("id").alias("up"), F.col("hit").alias("_hit"), F.col("up").alias("_up"))
        state = cut(state.join(above, "up", "left").select("id", "name", "own", F.col("_up").alias("up"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")))
    fourth = state.select(F.col("id").alias("up"), F.col("own").alias("_own"))
    said = reduce(lambda a, b: a | b, [F.contains(F.lower("name"), F.lit(w)) for w in words])
    return state.join(fourth, "up", "left").select("id", (F.col("hit") | F.coalesce("_own", F.lit(False)) | F.coalesce(said, F.lit(False))).alias("inside"))


def artifact_flows(produces: DataFrame, consumes: DataFrame, capabilities: DataFrame | None = None) -> DataFrame:
    """source, sink, producer_service, consumer_service: artifact A feeds B if the component that produces B consumes A.

    ``produces`` (artifact, component): the least component is an artifact's producer. ``consumes`` (artifact, component). Artifacts
    meet in their component, which is salted: what a component consumes is dealt, what it produces is repeated. Services are named by the
    last capability (name, component) that lists the component.
    """
    made = cut(produces.groupBy("artifact").agg(F.min("component").alias("component")))
    first = made.select(F.col("artifact").alias("source"), F.col("component").alias("producer"))
    used = consumes.select(F.col("artifact").alias("source"), "component").distinct().join(first, "source").withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    sinks = made.withColumnRenamed("artifact", "sink").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    flow = used.join(sinks, ["component", "salt"]).where("source <> sink").select("source", "sink", "producer", F.col("component").alias("consumer"))
    for side in ("producer", "consumer"):
        name = F.concat(side, F.lit(" Service"))
        if capabilities is not None:
            listed = capabilities.groupBy(F.col("component").alias(side)).agg(F.max("name").alias("_c"))
            flow = flow.join(listed, side, "left").withColumn(f"{side}_service", F.coalesce("_c", name)).drop("_c")
        else:
            flow = flow.withColumn(f"{side}_service", name)
    return flow.select("source", "sink", "producer_service", "consumer_service")
