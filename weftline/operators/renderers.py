"""Graphs as statements and diagrams: one row of text per line, so that writing them is distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_id
from ..plans.graph import Graph
from .windows import numbered_within


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def node_statements(nodes: DataFrame) -> DataFrame:
    """One MERGE a node; properties that are null are left out."""
    props = F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), quoted(F.col(c))) for c in ("id", "name", "service", "domain")))
    return nodes.select("id", F.concat(F.lit("MERGE (:"), "node_type", F.lit(" {"), props, F.lit("});")).alias("line"))


def edge_statements(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id", F.concat(F.lit("MATCH (a {id: "), quoted(F.col("from_id")), F.lit("}), (b {id: "), quoted(F.col("to_id")), F.lit("}) MERGE (a)-[:"), "relation", F.lit("]->(b);")).alias("line"))


def _unwound(rows: DataFrame, groups: list[str], order: list[str], props: Column, tail: Column, size: int) -> DataFrame:
    """groups, number, line: ``size`` rows of a group to a statement, in order."""
    p = numbered_within(rows.withColumn("_props", props), groups, order).withColumn("number", F.floor(F.col("place") / size))
    one = p.groupBy(*groups, "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_props"))), lambda x: x["_props"]).alias("_l"))  # size rows at most
    return one.select(*groups, "number", F.concat(F.lit("UNWIND ["), F.array_join("_l", ", "), F.lit("] AS row "), tail).alias("line"))


def unwind_nodes(nodes: DataFrame, groups: list[str] | None = None, size: int = 500) -> DataFrame:
    """Nodes by type, ``size`` to an UNWIND; properties that are null are left out."""
    props = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), quoted(F.col(c))) for c in ("id", "name", "service", "domain"))), F.lit("}"))
    tail = F.concat(F.lit("MERGE (n:"), "node_type", F.lit(" {id: row.id}) SET n += row;"))
    return _unwound(nodes, [*(groups or []), "node_type"], ["id"], props, tail, size)


def unwind_edges(edges: DataFrame, groups: list[str] | None = None, size: int = 500) -> DataFrame:
    """Edges by relation, ``size`` to an UNWIND, so that the store plans and matches once for each batch and not for each edge."""
    props = F.concat(F.lit("{from: "), quoted(F.col("from_id")), F.lit(", to: "), quoted(F.col("to_id")), F.lit("}"))
    tail = F.concat(F.lit("MATCH (a {id: row.from}) MATCH (b {id: row.to}) MERGE (a)-[:"), "relation", F.lit("]->(b);"))
    return _unwound(edges, [*(groups or []), "relation"], ["from_id", "to_id"], props, tail, size)


def memory_estimate(g: Graph) -> DataFrame:
    """MB that a graph store would need: 500 bytes a node, 200 an edge, 30 % for indexes."""
    sizes = g.nodes.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("e")))  # one row each
    mb = (F.col("n") * 500 + F.col("e") * 200) * 1.3 / 1048576
    return sizes.select(F.round(mb, 3).alias("data_mb"), F.round(F.greatest(F.lit(512.0), mb * 1.5), 3).alias("heap_mb"), F.round(F.greatest(F.lit(256.0), mb * 0.8), 3).alias("cache_mb"))


def flow_chart(pairs: DataFrame) -> DataFrame:
    """Lines of a Mermaid chart of source, target and n; ``at`` orders them."""
    body = pairs.select(F.concat(F.lit("1:"), "source", F.lit(":"), "target").alias("at"), F.concat(F.lit("  "), safe_id(F.col("source")), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), safe_id(F.col("target"))).alias("line"))
    return pairs.sparkSession.createDataFrame([("0", "flowchart LR")], "at string, line string").unionByName(body)


def chart_faults(lines: DataFrame) -> DataFrame:
    """Whether a chart has two nodes and an edge at least."""
    ends = lines.select(F.regexp_extract("line", r"^\s*(\w+) -->", 1).alias("a"), F.regexp_extract("line", r"(\w+)$", 1).alias("b")).where("a <> ''")
    return ends.agg(F.count("*").alias("n_edges"), F.size(F.array_union(F.collect_set("a"), F.collect_set("b"))).cast("long").alias("n_nodes")).withColumn("valid", (F.col("n_edges") >= 1) & (F.col("n_nodes") >= 2))


def steps(c: Column) -> list[Column]:
    """actor, other and action of ``A → B: action``."""
    p = r"^\s*(.+?)\s*→\s*(.+?)\s*(?::\s*(.*))?$"
    return [F.regexp_extract(c, p, i).alias(n) for i, n in ((1, "actor"), (2, "other"), (3, "action"))]


def contents(texts: DataFrame, ident: str) -> DataFrame:
    """Entries of a table of contents: the second-level headings of each text."""
    h = texts.select(ident, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^## (.+)$"), 1)).alias("number", "title"))
    return h.select(ident, "number", "title", F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9 -]", ""), " ", "-").alias("anchor"))


def restated(name: Column, comment: Column) -> Column:
    """Whether a comment repeats half the words of a name or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"), 1))
    return F.size(F.array_intersect(words, F.regexp_extract_all(F.lower(comment), F.lit("([a-z]+)"), 1))) * 2 >= F.size(words)
