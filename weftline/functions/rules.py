"""Classifiers and namers of symbols, routes and steps, as column expressions.

The word lists, patterns and names in this module are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import slug

NODE_PREFIX = {
    "FILE": "file", "CLASS": "cls", "INTERFACE": "iface", "FUNCTION": "func", "ASYNC_FUNCTION": "afunc", "METHOD": "meth", "SQL_QUERY": "qry", "REACT_COMPONENT": "comp",
    "REACT_HOOK": "hook", "SPARK_JOB": "spark", "SERVICE": "svc", "REPOSITORY": "repo", "CONTROLLER": "ctrl", "IMPORT": "imp", "API_ENDPOINT": "api", "DATAFRAME": "df", "SQL_TABLE": "tbl",
}
ROLES = {"parse": "parsing", "extract": "dependency_extraction", "graph": "graph_processing", "render": "diagram_rendering", "generate": "artifact_generation", "build": "semantic_building", "detect": "technology_detection", "analyze": "semantic_analysis"}
FLOWS = {
    "/users?": "User Management", "/auth": "Authentication", "/login": "User Login", "/register": "User Registration", "/payments?": "Payment Processing", "/orders?": "Order Management",
    "/products?": "Product Management", "/notifications?": "Notification Delivery", "/reports?": "Report Generation", "/search": "Search", "/upload": "File Upload", "/download": "File Download",
    "/admin": "Administration", "/health": "Health Check", "/metrics": "Metrics",
}
COMPONENT_LAYERS = {
    "Presentation": "api endpoint controller router view handler gateway",
    "Domain": "domain entity model schema semantic knowledge",
    "Infrastructure": "database db cache storage queue export neo4j docx dependency_extractor",
    "Application": "service workflow pipeline orchestrator use_case processor intelligence ast context combiner generator analysis",
}
CAPABILITY_LAYERS = {
    "Presentation": "controller|router|view|endpoint|handler|frontend|ui",
    "Application": "service|manager|orchestrator|use case|application",
    "Domain": "model|entity|schema|repository|domain|rule|aggregate",
    "Infrastructure": "database|cache|queue|config|infra|store|persistence|adapter",
}
TIERS = {"Controller": ["API_ENDPOINT", "CONTROLLER"], "Service": ["SERVICE"], "Repository": ["REPOSITORY"], "Database": ["SQL_TABLE", "MONGO_COLLECTION", "DATAFRAME"], "Function": ["FUNCTION", "ASYNC_FUNCTION", "METHOD"], "Component": ["CLASS"]}
RESTRICTED = "encryption_key|private_key|master_key|root_password"
CONFIDENTIAL = "patient|health|medical|ssn|passport|financial|transaction|payment|account|credit|social_security|password|secret|token|credential|hipaa"
SKIPPED_PREFIXES = "^(patch_|fix_|rewrite_|refactor_|test_|get_old_|final_patch_)"
PLACEHOLDERS = "/path|/test|/example|/placeholder|/foo|/bar|/mock|/sample"
SPRING = r"(?i)@(?:Service|Component|Controller|RestController|Repository|Injectable|Bean|Configuration)\b"
SPARK_JOB = r"(?i)\b(?:spark|sc|ss)\b.*\b(?:read|write|createDataFrame)\b"
SPARK_READ, SPARK_WRITE = r"(?i)(?:spark|sc|ss)\.read\.\w+\s*\(", r"(?i)\.write\.\w+\s*\("
FRAME_NAME = r"(\w+_df|\w+_data|df_\w+)\s*="
PASCAL, JSX = "^[A-Z][a-zA-Z0-9]+$", r"(?i)return\s+<[A-Z]"
ROUTE = r"(?i)(?:app|router)\.(?:route|get|post|put|patch|delete|use)\s*\(\s*['\"]([^'\"]+)['\"]"
ANNOTATION = r"(?i)@(Service|Repository|Controller|RestController|Component|Injectable|Entity|Configuration|Bean)"
API_WORDS = r"(?i)\b(axios|fetch|requests|http|HttpClient|get|post|put|patch|delete|request)\b"
DEPENDENCY_RELATION = {"EXPORT_USE": "DEPENDS_ON", "API_CALL": "CALLS_API", "FUNCTION_CALL": "CALLS", "SQL_USE": "QUERIES_TABLE", "MODULE_USE": "DEPENDS_ON", "CLASS_USE": "REFERENCES"}


def first_of(rules, otherwise) -> Column:
    """The value of the first rule (condition, value) that holds."""
    rules = list(rules)
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0])).otherwise(otherwise)


def node_id(node_type: Column, name: Column, context: Column) -> Column:
    prefix = first_of(((node_type == k, F.lit(v)) for k, v in NODE_PREFIX.items()), F.lit("node"))
    return F.concat_ws("__", prefix, *(F.nullif(slug(x), F.lit("")) for x in (name, context)))


def promoted(category: Column, name: Column, body: Column) -> Column:
    """Node type of a symbol; null for those that become no node."""
    annotation = F.lower(F.regexp_extract(body, SPRING, 0))
    kind = first_of([(F.contains(annotation, F.lit("repository")), "REPOSITORY"), (F.contains(annotation, F.lit("controller")), "CONTROLLER")], "SERVICE")
    react = F.contains(F.lower(body), F.lit("extends")) & F.contains(F.lower(body), F.lit("component")) & name.rlike(PASCAL)
    of_class = first_of([(annotation != "", kind), (react, F.lit("REACT_COMPONENT"))], "CLASS")
    of_function = first_of([(body.rlike(SPARK_JOB), "SPARK_JOB"), (name.rlike(PASCAL) & body.rlike(JSX), "REACT_COMPONENT"), (category == "ASYNC_DEF", "ASYNC_FUNCTION")], "FUNCTION")
    plain = {"INTERFACE": "INTERFACE", "ENUM": "ENUM", "METHOD": "METHOD", "CONSTRUCTOR": "CONSTRUCTOR", "HOOK": "REACT_HOOK", "VARIABLE": "VARIABLE", "CONSTANT": "CONSTANT", "PROPERTY": "PROPERTY", "ASSIGNMENT": "PROPERTY", "DECORATOR": "DECORATOR", "ANNOTATION": "DECORATOR", "LAMBDA": "LAMBDA", "IMPORT": "IMPORT"}
    return first_of([(category == "CLASS", of_class), (category.isin("FUNCTION", "ASYNC_DEF"), of_function), *((category == k, F.lit(v)) for k, v in plain.items())], F.lit(None))


def component_layer(name: Column) -> Column:
    return first_of(((F.lower(name).rlike("|".join(w.split())), F.lit(k)) for k, w in COMPONENT_LAYERS.items()), F.lit("Application"))


def capability_layer(name: Column) -> Column:
    return first_of(((F.lower(name).rlike(w), F.lit(k)) for k, w in CAPABILITY_LAYERS.items()), F.lit("Application"))


def lifecycle_tier(node_type: Column) -> Column:
    return first_of(((node_type.isin(v), F.lit(k)) for k, v in TIERS.items()), F.lit("Other"))


def semantic_role(name: Column) -> Column:
    return first_of(((F.contains(F.lower(name), F.lit(k)), F.lit(v)) for k, v in ROLES.items()), F.lit("general_processing"))


def data_sensitivity(name: Column) -> Column:
    return first_of([(F.lower(name).rlike(RESTRICTED), "Restricted"), (F.lower(name).rlike(CONFIDENTIAL), "Confidential")], "Internal")


def title(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def step_name(c: Column) -> Column:
    clean = F.regexp_replace(F.trim(c), "^_+", "")
    return F.when(clean == "", c).otherwise(title(F.regexp_replace(clean, "_", " ")))


def flow_name(endpoint: Column) -> Column:
    clean = F.regexp_replace(F.trim(endpoint, F.lit("/")), "[/_]", " ")
    clean = F.trim(F.regexp_replace(clean, r"\{[^}]+\}", ""))
    named = ((F.lower(endpoint).rlike(p), F.lit(f"{n} Flow")) for p, n in FLOWS.items())
    return first_of([*named, (clean != "", F.concat(title(clean), F.lit(" Flow")))], F.lit("Unknown Flow"))


def business_name(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")
    c = title(F.trim(F.regexp_replace(c, r"\s+", " ")))
    for suffix in ("Table", "Collection", "Schema", "Model", "Entity"):
        c = F.trim(F.regexp_replace(c, f" {suffix}$", ""))
    return c


def sql_category(c: Column) -> Column:
    first = F.upper(F.regexp_extract(c, r"^\s*([A-Za-z]+)\b", 1))
    return first_of([(first.isin("CREATE", "DROP", "ALTER", "TRUNCATE"), "SQL_DDL"), (first.isin("INSERT", "UPDATE", "DELETE", "MERGE"), "SQL_DML"), (first.isin("SELECT", "WITH"), "SQL_QUERY")], F.lit(None))


def sql_name(c: Column, number: Column) -> Column:
    kind = sql_category(c)
    table = F.regexp_extract(c, r"(?i)\bTABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:\w+\.)?(\w+)", 1)
    into = F.regexp_extract(c, r"(?i)\b(?:INTO|UPDATE|MERGE\s+INTO)\s+(?:\w+\.)?(\w+)", 1)
    source = F.regexp_extract(c, r"(?i)\bFROM\s+(?:\w+\.)?(\w+)", 1)
    n = number.cast("string")
    first = F.lower(F.regexp_extract(c, r"^\s*(\S+)", 1))
    return first_of(
        [
            (kind == "SQL_DDL", F.coalesce(F.nullif(table, F.lit("")), F.concat(F.lit("ddl_"), n))),
            (kind == "SQL_DML", F.when(into != "", F.concat_ws("_", first, into)).otherwise(F.concat(F.lit("dml_"), n))),
            (kind == "SQL_QUERY", F.concat(F.lit("query_"), F.coalesce(F.nullif(source, F.lit("")), n))),
        ],
        F.concat(F.lit("stmt_"), n),
    )


def import_spec(c: Column) -> Column:
    """What an import statement names: the first pattern that fits."""
    python, plain, quoted = F.regexp_extract(c, r"^from\s+([\w./]+)\s+import", 1), F.regexp_extract(c, r"^import\s+([\w./]+)", 1), F.regexp_extract(c, r"from\s+['\"]([^'\"]+)['\"]", 1)
    return F.coalesce(F.nullif(F.replace(python, F.lit("."), F.lit("/")), F.lit("")), F.nullif(F.replace(plain, F.lit("."), F.lit("/")), F.lit("")), F.nullif(quoted, F.lit("")))


def framework(text: Column) -> Column:
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    return first_of(
        [
            (has("from fastapi", "import fastapi"), "fastapi"), (has("from flask", "import flask"), "flask"), (has("from django"), "django"),
            (has("require('express')", "from 'express'"), "express"), (has("@Controller") & has("@Get"), "nestjs"), (has("@RestController", "@RequestMapping"), "spring"),
        ],
        "",
    )


def artifact_label(c: Column) -> Column:
    """Whether a label looks like a file path or a module."""
    words = F.lower(c).rlike("parsedfile|parsedproject|languagespec|architectureblueprint|parserregistry|batchrunner")
    return words | c.rlike(r"/[^/]*\.[^/]*$") | c.rlike(r"\.(py|js|ts|java|go|yaml|json)$") | c.rlike(r"^(backend|src)\.")


def transition(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    return first_of([(b.rlike("order|request|booking"), "Creates"), (b.rlike("payment|transaction"), "Triggers"), (b.rlike("record|log|history"), "Recorded in"), (a.rlike("cart|basket"), "Submitted as")], "Flows to")


#: Words of a component's name and symbols, in order, and the purpose that they tell.
PURPOSES = [
    ("extract|parser|reader|load", "Handles data extraction and parsing from raw inputs"),
    ("engine|processor|compute", "Core processing engine for business logic execution"),
    ("model|entity|schema|dto", "Defines domain models and data structures"),
    ("repo|database|store|cache", "Manages data persistence and retrieval"),
    ("api|controller|router|handler", "Provides public API endpoints and request routing"),
    ("auth|security|token|login", "Manages authentication and security controls"),
    ("config|settings|env", "Handles application configuration and environment settings"),
    ("util|helper|common", "Provides shared utilities and helper functions"),
    ("ui|view|render|template", "Manages presentation and user interface rendering"),
    ("diagram|mermaid|visual", "Generates visual diagrams and architectural representations"),
    ("document|docx|pdf|export", "Handles document generation and export"),
    ("comment|docstring|annotate", "Manages code documentation and semantic comments"),
    ("semantic|ir|knowledge|graph|translator", "Manages knowledge graph translation and semantic IR building"),
]


def purpose(name: Column, symbols: Column, has_endpoints: Column) -> Column:
    """A sentence on what a component with these symbols (a text) is for."""
    text, human = F.lower(F.concat_ws(" ", name, symbols)), title(F.replace(name, F.lit("_"), F.lit(" ")))
    by_api = F.concat(F.lit("Exposes REST API endpoints for "), human, F.lit(" operations and external integration."))
    otherwise = F.when(has_endpoints, by_api).otherwise(F.concat(F.lit("Manages "), human, F.lit(" operations and logic within the domain.")))
    return first_of([(text.rlike(words), F.lit(says + ".")) for words, says in PURPOSES], otherwise)


#: Patterns of message buses and data pipelines, in order, and the names of what they find.
BUSES = [r"(?i)\b(kafka|KafkaProducer|KafkaConsumer)\b", r"(?i)\b(rabbit|RabbitMQ|amqp)\b", r"(?i)\b(celery|dramatiq|huey)\b", r"(?i)\b(EventBus|MessageBus|eventbus)\b", r"(?i)\b(pubsub|publish|subscribe|emit|on_event)\b", r"(?i)\b(redis_queue|bull|nats)\b"]
BUS_NAMES = [("kafka", "Kafka"), ("rabbit|amqp", "RabbitMQ"), ("celery|dramatiq", "TaskQueue"), ("redis", "Redis"), ("nats", "NATS")]
PIPELINES = [r"(?i)\b(spark|pyspark|SparkSession)\b", r"(?i)\b(airflow|dag|luigi)\b", r"(?i)\b(etl|extract_transform|data_pipeline)\b", r"(?i)\b(beam|flink|dataflow)\b"]
PIPELINE_NAMES = [("spark", "Spark"), ("airflow|dag", "Airflow"), ("beam", "Beam"), ("flink", "Flink")]
PUBLISHES, SUBSCRIBES = "produce|publish|send|emit|dispatch", "consume|subscribe|on_|listener|handler"
#: Parts of a field's name, in order, and the type that they tell.
SQL_TYPES = [("_id|id", "INTEGER"), ("_at|date|time|created|updated|deleted", "TIMESTAMP"), ("is_|has_|enabled|active|flag", "BOOLEAN"), ("price|amount|cost|balance|rate", "DECIMAL(10,2)"), ("count|qty|quantity|num|age|score", "INTEGER"), ("email|url|path|name|title|desc", "VARCHAR(255)"), ("body|content|text|description|notes", "TEXT")]
PYTHON_TYPES = [("_id|count|num|qty|age", "int"), ("price|rate|amount|score", "float"), ("is_|has_|enabled|active", "bool"), ("_at|date|time|created|updated", "datetime"), ("items|tags|list|roles", "List")]
#: Beginnings of a method's name, in order, how many characters are cut, what stands around the rest, and what if nothing is left.
METHOD_WORDS = [("get|fetch|load", 3, "Returns ", ".", "data"), ("set|update|save", 3, "Updates ", ".", "data"), ("build|create|generate", 5, "Builds ", ".", "object"), ("extract|parse|analyze", 7, "Extracts ", " from input.", "data"), ("validate|check|verify", 8, "Validates ", ".", "input")]
#: Connection strings and imports, and the database that they tell.
DATABASES = [("sqlite:///|(import|from)\\s+sqlite3", "SQLite"), ("postgres(ql)?://|(import|from)\\s+psycopg2", "PostgreSQL"), ("mysql(\\+pymysql)?://|(import|from)\\s+pymysql", "MySQL"), ("mongodb(\\+srv)?://|(import|from)\\s+pymongo", "MongoDB"), ("redis://|(import|from)\\s+redis", "Redis")]


def detected(text: Column, patterns: list[str], names: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of what the first pattern that matches has found; null without a match."""
    token = F.lower(F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns)))
    return F.when(token.isNotNull(), first_of([(token.rlike(words), F.lit(n)) for words, n in names], F.lit(otherwise)))


def type_of_name(name: Column, types: list[tuple[str, str]], otherwise: str) -> Column:
    return first_of([(F.lower(name).rlike(words), F.lit(t)) for words, t in types], F.lit(otherwise))


def described(name: Column) -> Column:
    """A sentence on what a method does, from how its name begins."""
    low = F.lower(name)

    def noun(cut: int, empty: str) -> Column:
        return F.coalesce(F.nullif(F.trim(F.replace(F.substring(low, cut + 1, 1 << 30), F.lit("_"), F.lit(" "))), F.lit("")), F.lit(empty))

    human = F.replace(name, F.lit("_"), F.lit(" "))
    own = F.concat(F.upper(F.substring(human, 1, 1)), F.lower(F.substring(human, 2, 1 << 30)), F.lit("."))
    return first_of([(low.rlike(f"^({words})"), F.concat(F.lit(before), noun(cut, empty), F.lit(after))) for words, cut, before, after, empty in METHOD_WORDS], own)


def databases(text: Column) -> Column:
    """An array of the databases that a text connects to or imports."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for p, n in DATABASES)))
