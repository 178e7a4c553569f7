"""Source symbols and dependencies made from the part and order tables: one of each for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import table

CATEGORIES = ["CLASS", "FUNCTION", "METHOD", "ASYNC_DEF", "INTERFACE", "HOOK", "SQL_QUERY", "IMPORT"]
VERBS = ["get", "create", "parse", "extract_graph", "render", "generate", "build", "detect", "analyze", "test", "patch", "fix", "update"]
BODIES = [
    "@Repository class Store { }",
    "@RestController class Api { @app.get('/api/orders') }",
    "@Service class Billing extends Base { }",
    "rows_df = spark.read.parquet(path)",
    "orders_df = spark.read.csv(path); orders_df.write.parquet(out)",
    "SELECT * FROM orders o JOIN customers c ON o.id = c.id",
    "INSERT INTO audit SELECT * FROM orders; UPDATE stock SET n = 0",
    "return <Cart />; axios.get('/api/orders/12')",
    "class Page extends React.Component { fetch('/api/users') }",
    "CREATE TABLE IF NOT EXISTS ledger (id INT)",
]
IMPORTS = ["from app.models import Order", "import java.util.List;", "import { Chart } from './Chart'", "import helpers", "require('x')"]
TYPES = ["IMPORT", "EXPORT_USE", "API_CALL", "FUNCTION_CALL", "SQL_USE", "MODULE_USE", "CLASS_USE", "OTHER"]


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, category, name, parent, body."""
    k = F.col("p_partkey")
    category = _pick(CATEGORIES, k)
    label = F.concat(_pick(VERBS, k), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    name = F.when(category.isin("CLASS", "INTERFACE"), F.concat(F.lit("Class"), k)).when(category == "HOOK", F.concat(F.lit("useHook"), k)).when(category == "IMPORT", _pick(IMPORTS, F.floor(k / 8))).otherwise(label)
    path = F.concat(F.lit("app/"), F.floor(k / 80), F.lit("/m"), F.floor(k / 8) % 40, F.lit(".py"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), path.alias("path"), category.alias("category"), name.alias("name"), F.when(category == "METHOD", F.concat(F.lit("Class"), k - 2)).alias("parent"), _pick(BODIES, F.col("p_size")).alias("body")
    )


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, dep_type, symbol."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("src/a"), F.col("o_custkey") % 50, F.lit(".py")).alias("source"), F.concat(F.lit("src/a"), F.col("o_orderkey") % 50, F.lit(".py")).alias("target"), _pick(TYPES, F.col("o_orderkey")).alias("dep_type"), F.col("o_orderpriority").alias("symbol"))


#: The same in DuckDB, as the beginning of a WITH clause.
SYMBOLS_SQL = f"""
sym0 AS (SELECT p_partkey AS k, {_list(CATEGORIES)}[p_partkey % {len(CATEGORIES)} + 1] AS category, {_list(VERBS)}[p_partkey % {len(VERBS)} + 1] || '_' || replace(p_name, ' ', '_') AS label, {_list(BODIES)}[p_size % {len(BODIES)} + 1] AS body FROM part),
sym AS (
  SELECT k AS id, 'app/' || (k // 80) || '/m' || (k // 8 % 40) || '.py' AS path, category,
         CASE WHEN category IN ('CLASS', 'INTERFACE') THEN 'Class' || k WHEN category = 'HOOK' THEN 'useHook' || k WHEN category = 'IMPORT' THEN {_list(IMPORTS)}[k // 8 % {len(IMPORTS)} + 1] ELSE label END AS name,
         CASE WHEN category = 'METHOD' THEN 'Class' || (k - 2) END AS parent, body FROM sym0),
dep AS (SELECT 'src/a' || (o_custkey % 50) || '.py' AS source, 'src/a' || (o_orderkey % 50) || '.py' AS target, {_list(TYPES)}[o_orderkey % {len(TYPES)} + 1] AS dep_type, o_orderpriority AS symbol FROM orders)
"""
