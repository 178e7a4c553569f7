"""The property graph: nodes and edges as DataFrames, and the graph of the order tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, written


@dataclass(frozen=True)
class Graph:
    """nodes(id, name, node_type, service, domain) and edges(from_id, to_id, relation, weight)."""

    nodes: DataFrame
    edges: DataFrame


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + "__"), F.col(key).cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_state(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """Names, sizes and times of the tables' files: changes whenever one is written anew."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(conf)
        todo = [fs.getFileStatus(at)]
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo.extend(fs.listStatus(s.getPath()))
            else:
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


_WRITTEN: dict[tuple, Graph] = {}
ORDER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the order tables, written once per application and state of their files, so that its joins and counts are not planned anew for each use."""
    key = (spark.sparkContext.applicationId, sf_dir, file_state(spark, sf_dir, ORDER_TABLES))
    if key not in _WRITTEN:
        forget(spark, sf_dir)
        g = planned_graph(spark, sf_dir)
        _WRITTEN[key] = Graph(written(g.nodes, "nodes"), written(g.edges, "edges"))
    return _WRITTEN[key]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Drop the graphs written for a folder, with their files."""
    for key in [k for k in _WRITTEN if k[:2] == (spark.sparkContext.applicationId, sf_dir)]:
        g = _WRITTEN.pop(key)
        dropped(g.nodes)
        dropped(g.edges)


def planned_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders, with the links that their keys tell."""
    t = lambda name: table(spark, sf_dir, name)
    null = F.lit(None).cast("string")
    region = t("region").select("r_regionkey", "r_name")
    nation = t("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", "n_regionkey")
    where = nation.select("n_nationkey", F.col("r_name").alias("service"))
    customer = t("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(customer.select("c_custkey", "service", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))

    def nodes(df, prefix, key, name, service, domain):
        return df.select(_id(prefix, key).alias("id"), name.alias("name"), F.lit(prefix.upper()).alias("node_type"), service.alias("service"), domain.alias("domain"))

    all_nodes = (
        nodes(region, "region", "r_regionkey", F.col("r_name"), F.col("r_name"), null)
        .unionByName(nodes(nation, "nation", "n_nationkey", F.col("n_name"), F.col("r_name"), null))
        .unionByName(nodes(customer, "customer", "c_custkey", F.col("c_name"), F.col("service"), F.col("c_mktsegment")))
        .unionByName(nodes(supplier, "supplier", "s_suppkey", F.col("s_name"), F.col("service"), null))
        .unionByName(nodes(t("part"), "part", "p_partkey", F.col("p_name"), null, F.col("p_type")))
        .unionByName(nodes(orders, "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.col("service"), F.col("c_mktsegment")))
    )

    def edges(df, a, b, relation):
        n = df.groupBy(F.col(a[1]).alias("a"), F.col(b[1]).alias("b")).agg(F.count("*").alias("weight"))  # keys, not texts, are shuffled
        return n.select(_id(a[0], "a").alias("from_id"), _id(b[0], "b").alias("to_id"), "weight", F.lit(relation).alias("relation"))

    item = t("lineitem")
    all_edges = (
        edges(nation, ("nation", "n_nationkey"), ("region", "n_regionkey"), "BELONGS_TO")
        .unionByName(edges(t("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "BELONGS_TO"))
        .unionByName(edges(t("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "BELONGS_TO"))
        .unionByName(edges(t("orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "PLACES"))
        .unionByName(edges(item, ("order", "l_orderkey"), ("part", "l_partkey"), "CONTAINS"))
        .unionByName(edges(item, ("supplier", "l_suppkey"), ("part", "l_partkey"), "SUPPLIES"))
    ).select("from_id", "to_id", "relation", "weight")
    return Graph(all_nodes, all_edges)


#: The same graph in DuckDB, as the beginning of a WITH clause.
GRAPH_SQL = """
g_nodes AS (
  SELECT 'region__' || r_regionkey AS id, r_name AS name, 'REGION' AS node_type, r_name AS service, NULL AS domain FROM region
  UNION ALL SELECT 'nation__' || n_nationkey, n_name, 'NATION', r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer__' || c_custkey, c_name, 'CUSTOMER', r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier__' || s_suppkey, s_name, 'SUPPLIER', r_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'part__' || p_partkey, p_name, 'PART', NULL, p_type FROM part
  UNION ALL SELECT 'order__' || o_orderkey, 'Order ' || o_orderkey, 'ORDER', r_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g_edges AS (
  SELECT 'nation__' || n_nationkey AS from_id, 'region__' || n_regionkey AS to_id, 'BELONGS_TO' AS relation, 1 AS weight FROM nation
  UNION ALL SELECT 'customer__' || c_custkey, 'nation__' || c_nationkey, 'BELONGS_TO', 1 FROM customer
  UNION ALL SELECT 'supplier__' || s_suppkey, 'nation__' || s_nationkey, 'BELONGS_TO', 1 FROM supplier
  UNION ALL SELECT 'customer__' || o_custkey, 'order__' || o_orderkey, 'PLACES', 1 FROM orders
  UNION ALL SELECT 'order__' || l_orderkey, 'part__' || l_partkey, 'CONTAINS', count(*) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'supplier__' || l_suppkey, 'part__' || l_partkey, 'SUPPLIES', count(*) FROM lineitem GROUP BY ALL)
"""
