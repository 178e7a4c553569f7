"""Statistics, profiles, partitions and deltas of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..session import written
from .relational import enriched, with_integrity


def degrees(g: Graph) -> DataFrame:
    """id, in_degree, out_degree of every node."""
    out, in_ = (F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(1 - o).alias("i")) for c, o in (("from_id", 1), ("to_id", 0)))
    ends = g.edges.select(F.explode(F.array(out, in_)).alias("e")).select("e.*")  # both ends in one pass
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return g.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def hubs(g: Graph, k: int = 20) -> DataFrame:
    d = degrees(g).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    top = d.orderBy(F.desc("degree"), "id").limit(k)
    return g.nodes.join(F.broadcast(top), "id").select("id", "name", "node_type", "service", "in_degree", "out_degree", "degree")  # k rows


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n and its share of all rows in percent."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per value
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(everything), 4))


def profile(g: Graph) -> DataFrame:
    """One row: nodes, edges, mean degree, largest degree, density, seconds to load by fixed rates."""
    d = degrees(g).agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.max(F.col("in_degree") + F.col("out_degree")).alias("max_degree"))
    return d.select(
        "nodes", "edges", "max_degree",
        F.round(2.0 * F.col("edges") / F.col("nodes"), 4).alias("avg_degree"),
        F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)), 8).alias("density"),
        F.round(F.col("nodes") / 1000.0 + F.col("edges") / 500.0, 3).alias("load_seconds"),
    )


def degree_histogram(g: Graph) -> DataFrame:
    return degrees(g).groupBy((F.col("in_degree") + F.col("out_degree")).alias("degree")).agg(F.count("*").alias("n"))


def optimised(g: Graph) -> Graph:
    """Without orphans, doubled edges and blank texts."""
    e = written(with_integrity(g.nodes, g.edges), "edges")
    used = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    n = g.nodes.join(used, "id", "left_semi").withColumn("name", F.nullif(F.trim(F.substring("name", 1, 200)), F.lit("")))
    return Graph(n, e)


def partitions(g: Graph, column: str = "service", default: str = "__default__") -> DataFrame:
    """partition, nodes, edges inside, edges that leave it."""
    key = F.coalesce(column, F.lit(default))
    n = g.nodes.groupBy(key.alias("partition")).agg(F.count("*").alias("nodes"))
    e = enriched(g, (column,)).select(*(F.when(F.col(f"{s}_{column}") == "", F.lit(default)).otherwise(F.col(f"{s}_{column}")).alias(s) for s in ("from", "to")))
    e = e.groupBy(F.col("from").alias("partition")).agg(F.count_if(F.col("from") == F.col("to")).alias("edges"), F.count_if(F.col("from") != F.col("to")).alias("cross_edges"))
    return n.join(e, "partition", "left").select("partition", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("cross_edges", F.lit(0)).alias("cross_edges"))


def manifest(g: Graph, column: str = "service", default: str = "__default__") -> DataFrame:
    """partition, node_count, content_hash.

    The hash is taken over the counts and 64-bit sums of node hashes, which add up in any order, so a large
    partition is never gathered in one task.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", "node_type", "name"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    p = g.nodes.groupBy(F.coalesce(column, F.lit(default)).alias("partition")).agg(F.count("*").alias("node_count"), F.sum(h).alias("s"))
    return p.select("partition", "node_count", F.substring(F.sha2(F.concat_ws("|", "partition", "node_count", "s"), 256), 1, 16).alias("content_hash"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """partition, state: added, removed, changed, unchanged."""
    o, n = (d.select("partition", F.col("content_hash").alias(x)) for d, x in ((old, "o"), (new, "n")))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("unchanged")
    return o.join(n, "partition", "full_outer").select("partition", state.alias("state"))


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds batch: rows in order, ``size`` to a batch.

    Rows are numbered by counts of earlier range partitions, so no task sees all of them.
    """
    from .windows import global_row_number

    return global_row_number(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / size))


def split_partitions(g: Graph, size: int, column: str = "service", default: str = "__default__") -> DataFrame:
    """partition, sub, id: partitions over ``size`` nodes in parts of ``size`` by id (sub from 0); sub is null in those that fit.

    Rows are numbered by partition and id at once and shifted by the earlier partitions' counts, so no task sees a whole partition.
    """
    from .windows import global_row_number

    p = global_row_number(g.nodes.select(F.coalesce(column, F.lit(default)).alias("partition"), "id"), ["partition", "id"])
    n = p.groupBy("partition").agg(F.count("*").alias("_n"), F.min("rn").alias("_first"))
    sub = F.when(F.col("_n") > size, F.floor((F.col("rn") - F.col("_first")) / size))
    return p.join(F.broadcast(n), "partition").select("partition", sub.alias("sub"), "id")  # one row for each partition


def complexity(g: Graph) -> DataFrame:
    """id, complexity: degree and name length against their maxima, and a share for leaving the service."""
    d = degrees(g).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    x = g.nodes.join(d, "id").withColumn("body", F.length("name"))
    most = x.agg(F.max("degree").alias("md"), F.max("body").alias("mb"))
    out = enriched(g, ("service",)).where("from_service <> '' and to_service <> '' and from_service <> to_service").select(F.col("from_id").alias("id")).distinct().withColumn("crosses", F.lit(1))
    x = x.join(out, "id", "left").join(F.broadcast(most))  # one row
    score = 0.35 * F.col("degree") / F.col("md") + 0.25 * F.col("body") / F.col("mb") + 0.25 * F.when(F.col("crosses") == 1, 0.2).otherwise(0.0)
    return x.select("id", F.round(F.least(score, F.lit(1.0)), 4).alias("complexity"))


def code_complexity(nodes: DataFrame, edges: DataFrame, digits: int = 4) -> DataFrame:
    """id, complexity of nodes (id, service, body_chars, n_params): degree, body and parameters against their maxima, and a share for leaving the service."""
    d = degrees(Graph(nodes, edges)).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    x = nodes.join(d, "id")
    most = x.agg(*(F.greatest(F.max(c), F.lit(1)).alias(f"m_{c}") for c in ("degree", "body_chars", "n_params")))
    part = lambda side: nodes.where("service <> ''").select(F.col("id").alias(f"{side}_id"), F.col("service").alias(f"{side}_service"))
    out = edges.join(part("from"), "from_id").join(part("to"), "to_id").where("from_service <> to_service").select(F.col("from_id").alias("id")).distinct().withColumn("_crosses", F.lit(0.2))
    x = x.join(out, "id", "left").crossJoin(most)  # one row
    score = 0.35 * F.col("degree") / F.col("m_degree") + 0.25 * F.col("body_chars") / F.col("m_body_chars") + 0.15 * F.col("n_params") / F.col("m_n_params") + 0.25 * F.coalesce("_crosses", F.lit(0.0))
    return x.select("id", F.round(F.least(score, F.lit(1.0)), digits).alias("complexity"))


def confidence(n) -> F.Column:
    return F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low")


def job_metrics(events: DataFrame) -> DataFrame:
    """Events as a job log: totals, done, failed and mean value by type."""
    return events.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 50).alias("done"), F.count_if(F.col("value") < 50).alias("failed"), F.round(F.avg("value"), 1).alias("avg_value"))
