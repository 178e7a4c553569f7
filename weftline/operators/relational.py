"""Filters, joins and set operations on graphs and text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph


# --- filters ------------------------------------------------------------------
def by_type(g: Graph, node_type: str) -> DataFrame:
    return g.nodes.where(F.col("node_type") == node_type)


def by_relation(g: Graph, relation: str) -> DataFrame:
    return g.edges.where(F.col("relation") == relation)


def blank_to_null(c: Column, most: int | None = None) -> Column:
    c = F.substring(c, 1, most) if most else c
    return F.nullif(F.trim(c), F.lit(""))


def find_node(g: Graph, name: str, node_type: str | None = None) -> DataFrame:
    """The first node (by id) whose name contains ``name`` in any case."""
    found = g.nodes.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if node_type:
        found = found.where(F.col("node_type") == node_type)
    return found.orderBy("id").limit(1)


def cluster(g: Graph, service: str | None = None, domain: str | None = None) -> DataFrame:
    """Nodes whose service or domain contains a text in any case."""
    out = g.nodes
    for column, value in (("service", service), ("domain", domain)):
        if value is not None:
            out = out.where(F.contains(F.lower(column), F.lit(value.lower())))
    return out


# --- joins ----------------------------------------------------------------------
def with_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist and differ, one of each (from, to, relation): the heaviest."""
    ids = nodes.select("id")
    ok = edges.where("from_id <> to_id").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return ok.groupBy("from_id", "to_id", "relation").agg(F.max("weight").alias("weight"))


def enriched(g: Graph, columns=("name", "node_type", "service")) -> DataFrame:
    """Edges with from_* and to_* columns of their ends; missing ends give empty texts."""
    out = g.edges
    for side in ("from", "to"):
        own = g.nodes.select(F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        out = out.join(own, f"{side}_id", "left")
    return out.select("from_id", "to_id", "relation", "weight", *(F.coalesce(f"{s}_{c}", F.lit("")).alias(f"{s}_{c}") for s in ("from", "to") for c in columns))


def neighbours(g: Graph, direction: str = "both") -> DataFrame:
    """id, neighbour; a bag."""
    out = g.edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("neighbour"))
    back = g.edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("neighbour"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


def induced(g: Graph, nodes: DataFrame) -> Graph:
    ids = nodes.select("id")
    e = g.edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return Graph(g.nodes.join(ids, "id", "left_semi"), e)


def cross_counts(g: Graph, column: str = "service") -> DataFrame:
    """How many edges lead from one value of ``column`` to another one, by relation."""
    e = enriched(g, (column,))
    a, b = f"from_{column}", f"to_{column}"
    return e.where((F.col(a) != F.col(b)) & (F.col(a) != "") & (F.col(b) != "")).groupBy(F.col(a).alias("source"), F.col(b).alias("target"), "relation").agg(F.count("*").alias("n"))


def orphans(g: Graph, exempt=()) -> DataFrame:
    """Nodes at no edge."""
    used = g.edges.select(F.col("from_id").alias("id")).unionAll(g.edges.select(F.col("to_id").alias("id")))
    out = g.nodes.join(used, "id", "left_anti")
    return out.where(~F.col("node_type").isin(*exempt)) if exempt else out


def as_of_next(left: DataFrame, right: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """For each row of ``left`` the first row of ``right`` with the same key that comes later (by ``at``, then ``ident``).

    One sort of the union of both instead of a range join; the look-ahead is a window per key.
    """
    marked = left.select(key, at, F.col(ident).alias("left_id"), F.lit(None).cast("long").alias("right_id"), F.lit(None).cast("timestamp").alias("right_at")).unionByName(
        right.select(key, at, F.lit(None).cast("long").alias("left_id"), F.col(ident).alias("right_id"), F.col(at).alias("right_at"))
    )
    # at equal times a row of ``right`` counts as before, so that it is later only when strictly later
    # latest first, so that the frame only grows and each row is looked at once
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("right_id").isNull().desc(), F.col("right_id").desc(), F.col("left_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = marked.withColumn("next_id", F.last("right_id", ignorenulls=True).over(w)).withColumn("next_at", F.last("right_at", ignorenulls=True).over(w))
    return found.where("left_id is not null").select("left_id", key, at, "next_id", "next_at")


def prioritised(candidates: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Of several strategies' matches the first strategy's best for each key; adds priority."""
    all_ = reduce(DataFrame.unionByName, [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)])
    w = Window.partitionBy(key).orderBy("priority", *order)
    return all_.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """call -> route: equal, else the longest route that is a prefix by whole segments, else equal but for {} segments.

    Each strategy is an equi-join: a call is exploded into its prefixes, and a route with placeholders meets calls
    of as many segments with the same first fixed segment.
    """
    c, r = calls.select("call").distinct(), routes.select("route").distinct()
    exact = c.join(r, F.col("call") == F.col("route")).select("call", "route")
    parts = F.split("call", "/")
    prefixes = c.withColumn("n", F.explode(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))))).where(F.col("n") < F.size(parts)).withColumn("route", F.array_join(F.slice(parts, 1, F.col("n")), "/"))
    prefix = prefixes.join(r, "route").select("call", "route")
    rw = r.where(F.contains("route", F.lit("{}"))).withColumn("rs", F.split("route", "/"))
    wild = c.withColumn("cs", parts).join(rw, (F.size("cs") == F.size("rs")) & (F.get("cs", F.lit(1)) == F.get("rs", F.lit(1))))
    wild = wild.where(F.forall(F.zip_with("cs", "rs", lambda a, b: (a == b) | (b == "{}")), lambda x: x)).select("call", "route")
    return prioritised([exact, prefix, wild], "call", [F.length("route").desc(), F.col("route")])


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``first`` and those rows of ``second`` whose keys it doesn't have."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def reverse_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (a < b) that occur both ways."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pairs.join(back, ["a", "b"], "left_semi").where("a < b").select("a", "b").distinct()
