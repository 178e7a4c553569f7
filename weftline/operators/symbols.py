"""Edges that symbols and dependencies tell, and what becomes of symbols as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def structure(sym: DataFrame) -> DataFrame:
    """from_key, to_key, relation: files contain symbols and define the primary ones; classes contain and define members of the same file."""
    file = sym.where("category <> 'IMPORT'").select(F.col("path").alias("from_key"), F.concat_ws("::", "path", "name").alias("to_key"), "category")
    contains = file.select("from_key", "to_key", F.lit("CONTAINS").alias("relation"))
    defines = file.where(F.col("category").isin("CLASS", "INTERFACE", "ENUM", "FUNCTION", "ASYNC_DEF")).select("from_key", "to_key", F.lit("DEFINES").alias("relation"))
    classes = sym.where(F.col("category").isin("CLASS", "INTERFACE")).select("path", F.col("name").alias("parent")).distinct()
    member = sym.where(F.col("category").isin("METHOD", "CONSTRUCTOR", "PROPERTY", "ASSIGNMENT", "VARIABLE")).join(classes, ["path", "parent"])
    member = member.select(F.concat_ws("::", "path", "parent").alias("from_key"), F.concat_ws("::", "path", "name").alias("to_key"), F.explode(F.array(F.lit("CONTAINS"), F.lit("DEFINES"))).alias("relation"))
    return contains.unionByName(defines).unionByName(member).distinct()


def file_edges(dep: DataFrame, imports: bool) -> DataFrame:
    """source, target, relation of import dependencies, or of all others by their type."""
    kind = F.col("dep_type")
    relation = F.lit("IMPORTS") if imports else rules.first_of(((kind == k, F.lit(v)) for k, v in rules.DEPENDENCY_RELATION.items()), F.lit("DEPENDS_ON"))
    return dep.where((kind == "IMPORT") if imports else (kind != "IMPORT")).where("source <> target").select("source", "target", relation.alias("relation")).distinct()


def spark_frames(sym: DataFrame) -> DataFrame:
    """path, name, frame, relation of symbols that read or write with Spark."""
    body = F.col("body")
    relation = F.when(body.rlike(rules.SPARK_WRITE), "WRITES_TO").otherwise("READS_FROM")
    jobs = sym.where(body.rlike(rules.SPARK_READ) | body.rlike(rules.SPARK_WRITE))
    return jobs.select("path", "name", F.explode(F.regexp_extract_all("body", F.lit(rules.FRAME_NAME), 1)).alias("frame"), relation.alias("relation")).distinct()


def found(sym: DataFrame, pattern: str, name: str) -> DataFrame:
    """path, symbol and each distinct match of a pattern in its body."""
    return sym.select("path", F.col("name").alias("symbol"), F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias(name)).distinct()
