"""Sources and sinks: source trees, XML, JSON and CSV graphs, Markdown blocks, endpoints."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph

# Languages by extension.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".sql": "sql"}
NODE_SCHEMA = "id string, name string, node_type string, service string, domain string"
EDGE_SCHEMA = "from_id string, to_id string, relation string, weight long"


def language(path) -> F.Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def scan_files(spark: SparkSession, root: str, most_mb: int = 10, skip: str = r"/(\.git|node_modules|__pycache__|venv)/") -> DataFrame:
    """path, language, text of source files below ``root``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.where((F.col("length") <= most_mb << 20) & ~F.col("path").rlike(skip))
    return f.select("path", language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text")).where("language is not null")


def write_graph(g: Graph, path: str, kind: str = "parquet") -> None:
    """parquet, json, csv (all quoted) or xml."""
    for name, df, row in (("nodes", g.nodes, "Node"), ("edges", g.edges, "Edge")):
        w = df.write.mode("overwrite").format(kind)
        if kind == "csv":
            w = w.options(header=True, quoteAll=True)
        if kind == "xml":
            w = w.options(rowTag=row, rootTag=name.capitalize())
        w.save(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, kind: str = "parquet") -> Graph:
    out = []
    for name, schema, row in (("nodes", NODE_SCHEMA, "Node"), ("edges", EDGE_SCHEMA, "Edge")):
        r = spark.read.format(kind).schema(schema)
        if kind == "csv":
            r = r.options(header=True)
        if kind == "xml":
            r = r.options(rowTag=row)
        out.append(r.load(f"{path}/{name}"))
    return Graph(*out)


ROUTE = re.compile(r"@\w+\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]+)['\"]")


def endpoints(files: DataFrame) -> DataFrame:
    """path, method, route, line of decorated handlers."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "code"))
    hit = lines.where(F.col("code").rlike(ROUTE.pattern))
    return hit.select("path", F.upper(F.regexp_extract("code", ROUTE.pattern, 1)).alias("method"), F.regexp_extract("code", ROUTE.pattern, 2).alias("route"), (F.col("at") + 1).alias("line"))


def markdown_blocks(texts: DataFrame, ident: str) -> DataFrame:
    """Lines of Markdown grouped to blocks: ident, island, kind, n_lines."""
    from ..operators.windows import islands

    lines = texts.select(ident, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    kind = F.when(F.col("line").rlike(r"^\s*$"), "blank").when(F.col("line").rlike(r"^#{1,6} "), "heading").when(F.col("line").rlike(r"^\s*([-*]|\d+\.) "), "list").when(F.col("line").rlike(r"^\|"), "table").otherwise("paragraph")
    x = islands(lines.withColumn("kind", kind), ident, "at", "kind")
    return x.groupBy(ident, "island", "kind").agg(F.count("*").alias("n_lines")).where("kind <> 'blank'")
