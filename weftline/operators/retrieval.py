"""Ranked and budgeted context around a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from .aggregates import degrees
from .graphs import k_hop

# How much a node's type weighs in its relevance.
TYPE_WEIGHT = {"CUSTOMER": 1.0, "ORDER": 0.9, "SUPPLIER": 0.8, "PART": 0.7, "NATION": 0.5, "REGION": 0.4}


def ranked(g: Graph, target: str, hops: int = 2) -> DataFrame:
    """Neighbours of a node by relevance: degree, nearness, domain, type and a shared service."""
    seed = g.nodes.where(F.col("id") == target)
    own = seed.select(F.col("service").alias("own_service"), F.col("domain").alias("own_domain"))
    d = degrees(g).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    near = k_hop(g, seed, hops).select("id", "hop")
    x = near.join(g.nodes, "id").join(d, "id").join(F.broadcast(own))  # one row
    weight = F.coalesce(*(F.when(F.col("node_type") == k, v) for k, v in TYPE_WEIGHT.items()), F.lit(0.4))
    shared = F.when(F.col("service") == F.col("own_service"), 1.0).when(F.col("domain") == F.col("own_domain"), 0.5).otherwise(0.0)
    score = 0.30 * F.least(F.col("degree") / 100.0, F.lit(1.0)) + 0.25 / F.col("hop") + 0.20 * F.when(F.col("domain").isNotNull(), 0.5).otherwise(0.0) + 0.15 * weight + 0.10 * shared
    return x.select("id", "name", "node_type", "hop", F.round(score, 6).alias("relevance"))


# How much a code node's type weighs.
CODE_WEIGHT = {
    "API_ENDPOINT": 1.0, "API_CALL": 0.9, "CONTROLLER": 0.9, "SERVICE": 0.85, "MICROSERVICE": 0.85, "ASYNC_FUNCTION": 0.8, "FUNCTION": 0.75, "METHOD": 0.75, "CLASS": 0.7, "REACT_COMPONENT": 0.7, "SQL_TABLE": 0.7,
    "MONGO_COLLECTION": 0.7, "SPARK_JOB": 0.65, "CONSTRUCTOR": 0.6, "INTERFACE": 0.6, "ENUM": 0.55, "MODULE": 0.5, "FILE": 0.45, "IMPORT": 0.3, "VARIABLE": 0.3, "CONSTANT": 0.3, "PROPERTY": 0.3, "DECORATOR": 0.25, "LAMBDA": 0.25,
}


def relevance(near: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """seed, id, hop, relevance of rows near (seed, id, hop): centrality, nearness, flow or domain, type, and the seed's service or domain.

    ``nodes``: id, node_type, service, domain, centrality; ``flows``: ids of nodes in business flows.
    """
    own = nodes.select(F.col("id").alias("seed"), F.col("service").alias("own_service"), F.col("domain").alias("own_domain"))
    x = near.join(nodes, "id").join(own, "seed").join(flows.select("id", F.lit(True).alias("_flow")).distinct(), "id", "left")
    weight = F.coalesce(*(F.when(F.col("node_type") == k, v) for k, v in CODE_WEIGHT.items()), F.lit(0.4))
    close = F.when(F.col("hop") > 0, 1.0 / F.col("hop")).otherwise(1.0)
    business = F.when(F.col("_flow"), 1.0).when(F.col("domain") != "", 0.5).otherwise(0.0)
    shared = F.when((F.col("own_service") != "") & (F.col("service") == F.col("own_service")), 1.0).when((F.col("own_domain") != "") & (F.col("domain") == F.col("own_domain")), 0.5).otherwise(0.0)
    score = 0.30 * F.least("centrality", F.lit(1.0)) + 0.25 * close + 0.20 * business + 0.15 * weight + 0.10 * shared
    return x.select("seed", "id", "hop", F.round(score, 6).alias("relevance"))


def top_of_each(ranked_: DataFrame, k: int) -> DataFrame:
    """The ``k`` most relevant rows of each seed, each id once, with their place."""
    w = Window.partitionBy("seed").orderBy(F.desc("relevance"), "id")
    once = ranked_.groupBy("seed", "id").agg(F.max("relevance").alias("relevance"))
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_context(r: DataFrame, k: int) -> DataFrame:
    return r.orderBy(F.desc("relevance"), "id").limit(k)


def within_budget(items: DataFrame, group: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while their tokens add up to ``budget`` at most."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running", F.sum(tokens).over(w)).where(F.col("running") <= budget)


def chunk_text(g: Graph, most: int = 5) -> DataFrame:
    """id, chunk: a node's type, name and place, and up to ``most`` of its targets by name."""
    out = g.edges.join(g.nodes.select(F.col("id").alias("to_id"), F.col("name").alias("target")), "to_id")
    w = Window.partitionBy("from_id").orderBy("target", "relation")
    out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "target"))), lambda x: x["target"]), ", ").alias("targets"))
    return g.nodes.join(out, "id", "left").select(
        "id", F.concat_ws(" | ", F.concat(F.lit("["), "node_type", F.lit("]"), F.lit(" "), "name"), F.concat(F.lit("service: "), "service"), F.concat(F.lit("links: "), "targets")).alias("chunk")
    )


def delta_operations(g: Graph, states: DataFrame, column: str = "service", default: str = "__default__") -> DataFrame:
    """kind, partition, n: nodes to add from added and changed partitions, and a mark for each removed one."""
    changed = states.where(F.col("state").isin("added", "changed"))
    nodes = g.nodes.select(F.coalesce(column, F.lit(default)).alias("partition")).join(changed, "partition").groupBy("partition").agg(F.count("*").alias("n"))
    gone = states.where("state = 'removed'").select(F.lit("delete_partition").alias("kind"), "partition", F.lit(1).cast("long").alias("n"))
    return nodes.select(F.lit("add_nodes").alias("kind"), "partition", "n").unionByName(gone)
