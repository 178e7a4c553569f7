"""Graphs as XML with declared counts, and as one folder for each partition, committed by rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators.relational import with_integrity
from ..plans.graph import Graph
from ..session import dropped, no_shuffle_left, written

NODE_XML = "_id string, _type string, _name string, _service string, _domain string, _start_line string, DocString string, Parameters struct<Param:array<string>>"
EDGE_XML = "_from string, _to string, _relation string, _weight string, _confidence string"
GRAPH_XML = "_name string, _nodes string, _edges string"
# How far loaded counts may be from declared ones.
NODE_TOLERANCE, EDGE_TOLERANCE = 0.01, 0.05


class CountMismatch(ValueError):
    """A graph file doesn't hold what it declares."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commit(spark: SparkSession, attempt: str, path: str) -> None:
    """Put a whole attempt in the place of ``path``; what was there goes only once the new one is in place."""
    fs, new = _fs(spark, attempt)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"can't move {path} away")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"can't commit {path}")
    if had:
        fs.delete(old, True)


def _whole(spark: SparkSession, path: str, write) -> None:
    """Run ``write(folder)`` on an attempt of its own and commit it; a failed one leaves ``path`` as it was."""
    attempt = f"{path.rstrip('/')}.attempt-{uuid.uuid4().hex}"
    try:
        write(attempt)
    except BaseException:
        fs, at = _fs(spark, attempt)
        fs.delete(at, True)
        raise
    commit(spark, attempt, path.rstrip("/"))


# --- XML -------------------------------------------------------------------------------
def write_graph_xml(g: Graph, path: str, name: str = "graph") -> None:
    """Nodes by (type, name, id) and edges by (relation, from, to) as XML rows, and a head with their counts, which are observed while they are written."""
    spark = g.nodes.sparkSession
    attr = lambda c: F.col(c).cast("string")
    extra = {c for c in ("docstring", "params", "start_line") if c in g.nodes.columns}
    node = [attr("id").alias("_id"), attr("node_type").alias("_type"), attr("name").alias("_name"), attr("service").alias("_service"), attr("domain").alias("_domain")]
    node += [attr("start_line").alias("_start_line")] if "start_line" in extra else []
    node += [attr("docstring").alias("DocString")] if "docstring" in extra else []
    node += [F.struct(F.col("params").alias("Param")).alias("Parameters")] if "params" in extra else []
    edge = [attr("from_id").alias("_from"), attr("to_id").alias("_to"), attr("relation").alias("_relation"), attr("weight").alias("_weight")]

    def write(at: str) -> None:
        counts = {}
        for what, df, cols, order, row in (("nodes", g.nodes, node, ["_type", "_name", "_id"], "Node"), ("edges", g.edges, edge, ["_relation", "_from", "_to"], "Edge")):
            seen = Observation()
            # on top of the sort, whose sampling would count the rows once more
            df.select(*cols).orderBy(*order).observe(seen, F.count(F.lit(1)).alias("n")).write.format("xml").options(rowTag=row, rootTag=row + "s").save(f"{at}/{what}")
            counts[what] = str(seen.get["n"])
        head = spark.createDataFrame([(name, counts["nodes"], counts["edges"])], GRAPH_XML)
        head.coalesce(1).write.format("xml").options(rowTag="DependencyGraph", rootTag="Graphs").save(f"{at}/graph")

    _whole(spark, path, write)


def _text(c: str, default: str | None = "") -> F.Column:
    t = F.nullif(F.trim(F.col(c)), F.lit(""))
    return t if default is None else F.coalesce(t, F.lit(default))


def read_graph_xml(spark: SparkSession, path: str, children: bool = True, strict: bool = True) -> tuple[Graph, list[str]]:
    """The graph, written anew, and what is wrong with it; with ``strict`` a wrong count raises.

    Of nodes with one id the last one in the order of files and places in them stays; nodes without id and edges without an end are left
    out, edges are as with_integrity leaves them. Numbers that are none count as 0 (weights as 1). Without ``children`` only
    attributes are read. Counts are observed in the pass that writes the graph.
    """
    read = lambda what, row, schema: spark.read.format("xml").options(rowTag=row).schema(schema).load(f"{path}/{what}")
    head = read("graph", "DependencyGraph", GRAPH_XML).first()
    raw = read("nodes", "Node", NODE_XML)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    fields = [_text("_type").alias("node_type"), _text("_name").alias("name"), _text("_service", None).alias("service"), _text("_domain", None).alias("domain"), F.coalesce(F.expr("try_cast(_start_line AS int)"), F.lit(0)).alias("start_line")]
    if children:
        fields += [_text("DocString", None).alias("docstring"), F.coalesce(F.filter(F.transform("Parameters.Param", F.trim), lambda p: p != ""), F.array().cast("array<string>")).alias("params")]
    rows = raw.select(_text("_id").alias("id"), F.struct(*fields).alias("n"), place.alias("at")).where("id <> ''")
    seen_nodes, seen_edges, seen_rows = Observation(), Observation(), Observation()
    last = rows.groupBy("id").agg(F.max_by("n", "at").alias("n")).select("id", "n.*")
    nodes = written(last.observe(seen_nodes, F.count(F.lit(1)).alias("n")), "nodes")
    edges = read("edges", "Edge", EDGE_XML).observe(seen_rows, F.count(F.lit(1)).alias("n"))
    edges = edges.select(_text("_from").alias("from_id"), _text("_to").alias("to_id"), _text("_relation").alias("relation"), F.coalesce(F.expr("try_cast(_weight AS double)"), F.lit(1.0)).cast("long").alias("weight"))
    kept = with_integrity(nodes, edges.where("from_id <> '' and to_id <> ''"))
    edges = written(kept.observe(seen_edges, F.count(F.lit(1)).alias("n")), "edges")
    errors = []
    for what, declared, n, tolerance in (("Node", head["_nodes"], seen_nodes.get["n"], NODE_TOLERANCE), ("Edge", head["_edges"], seen_edges.get["n"], EDGE_TOLERANCE)):
        expected = int(declared) if declared and declared.strip().isdigit() else 0
        if expected and abs(n - expected) > expected * tolerance:
            more = f" (skipped {seen_rows.get['n'] - n})" if what == "Edge" else ""
            errors.append(f"{what} count mismatch: expected {expected}, loaded {n}{more}")
    if errors and strict:
        raise CountMismatch("; ".join(errors))
    return Graph(nodes, edges), errors


# --- partitions --------------------------------------------------------------------------
def _placed(g: Graph, column: str, default: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with their partition, and edges with the partitions of both ends."""
    key = F.regexp_replace(F.coalesce(column, F.lit(default)), "/", "_")
    own = g.nodes.select("id", key.alias("partition"))
    ends = g.edges
    for side in ("from", "to"):
        ends = ends.join(own.toDF(f"{side}_id", f"{side}_partition"), f"{side}_id")
    return g.nodes.withColumn("partition", key), ends


def export_partitions(g: Graph, path: str, column: str = "service", default: str = "__default__") -> None:
    """Quoted CSV (gzip) of each partition's nodes and inner edges, cross edges, and a manifest of counts and hashes; all or nothing.

    A partition is written by as many tasks as hold rows of it, so a large one is no single task's work. The edges meet their partitions once
    and are written for the three that read them, so that the disk holds the shuffle of one join and none after it.
    """
    nodes, ends = _placed(g, column, default)
    ends = written(ends, "placed")
    same = F.col("from_partition") == F.col("to_partition")

    def write(at: str) -> None:
        csv = lambda df, what, *by: df.write.partitionBy(*by).options(quoteAll=True, compression="gzip", **CSV).csv(f"{at}/{what}")
        csv(nodes, "nodes", "partition")
        csv(ends.where(same).withColumn("partition", F.col("from_partition")).drop("from_partition", "to_partition"), "edges", "partition")
        csv(ends.where(~same), "cross_partition_edges")
        inside = ends.groupBy(F.col("from_partition").alias("partition")).agg(F.count_if(same).alias("edge_count"), F.count_if(~same).alias("cross_partition_edge_count"))
        stats = agg.manifest(Graph(nodes, g.edges), "partition").join(inside, "partition", "left")
        stats.select("partition", "node_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("edge_count", "cross_partition_edge_count")), "content_hash").write.json(f"{at}/manifest")

    try:
        with no_shuffle_left(g.nodes.sparkSession):
            _whole(g.nodes.sparkSession, path, write)
    finally:
        dropped(ends)


#: White space is part of a value, on both ways.
CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
MANIFEST = "partition string, node_count long, edge_count long, cross_partition_edge_count long, content_hash string"


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges, cross_partition_edges and manifest of an export; texts but for the manifest's counts."""
    csv = lambda what: spark.read.options(inferSchema=False, **CSV).csv(f"{path}/{what}")
    out = {w: csv(w) for w in ("nodes", "edges", "cross_partition_edges")}
    return out | {"manifest": spark.read.schema(MANIFEST).json(f"{path}/manifest")}


def statement_batches(g: Graph, size: int = 500, column: str = "service", default: str = "__default__") -> DataFrame:
    """batch, kind, number, line: each partition's nodes by type and inner edges by relation, then the cross edges, ``size`` rows to an UNWIND.

    The batches come in the order of their names: partitions first, cross_partition last.
    """
    from ..operators.renderers import unwind_edges, unwind_nodes

    nodes, ends = _placed(g, column, default)
    same = F.col("from_partition") == F.col("to_partition")
    batch = F.when(same, F.concat(F.lit("1_"), "from_partition")).otherwise("2_cross_partition")
    n = unwind_nodes(nodes.withColumn("batch", F.concat(F.lit("1_"), "partition")), ["batch"], size).select("batch", F.lit("1_node").alias("kind"), F.col("node_type").alias("label"), "number", "line")
    e = unwind_edges(ends.withColumn("batch", batch), ["batch"], size).select("batch", F.lit("2_edge").alias("kind"), F.col("relation").alias("label"), "number", "line")
    return n.unionByName(e)


def export_statements(g: Graph, path: str, size: int = 500, column: str = "service", default: str = "__default__") -> None:
    """One folder of text for each batch, and the list of batches with their number of statements; all or nothing."""

    def write(at: str) -> None:
        lines = written(statement_batches(g, size, column, default), "statements")
        lines.repartition("batch", "kind", "label").sortWithinPartitions("batch", "kind", "label", "number").select("batch", "line").write.partitionBy("batch").text(f"{at}/batches")
        lines.groupBy("batch").agg(F.count("*").alias("statements")).orderBy("batch").write.json(f"{at}/manifest")

    _whole(g.nodes.sparkSession, path, write)
