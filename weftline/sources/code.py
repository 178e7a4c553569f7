"""What source texts tell, line by line or match by match, with built-in functions over files(path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import statement_kind

#: What a keyword before a table's name does with it.
TABLE_USES = {"QUERIES_TABLE": r"(?i)\b(?:from|join)\s+([a-z_]\w*)", "WRITES_TABLE": r"(?i)\b(?:into|update)\s+([a-z_]\w*)", "CREATES_TABLE": r"(?i)\bcreate\s+(?:table|view)\s+(?:if\s+not\s+exists\s+)?([a-z_]\w*)"}
# Words after such a keyword that are no tables.
NOT_TABLES = (
    "select where and or not in on as set all distinct group order by having limit offset union except intersect case when then else end null exists count sum avg"
    " max min coalesce current_date current_timestamp interval primary key unique index constraint default references if with values into true false is like between"
).split()
DEFINED = r"(?:class|def|function|interface)\s+([A-Za-z_]\w*)"


def _found(names: Column, key: str, relation: str) -> Column:
    return F.transform(names, lambda x: F.struct(x.alias(key), F.lit(relation).alias("relation")))


def matches(files: DataFrame, pattern: str, name: str, group: int = 1) -> DataFrame:
    """path and each distinct match of a pattern."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), group))).alias(name))


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def statements(files: DataFrame, most: int = 200) -> DataFrame:
    """SQL statements that end with a semicolon at a line's end, with number, kind and preview."""
    parts = files.select("path", F.posexplode(F.split("text", r";\s*(?:\n|$)")).alias("number", "statement")).withColumn("statement", F.trim(F.regexp_replace("statement", r"\s+", " ")))
    return parts.where("statement <> ''").select("path", "number", statement_kind(F.col("statement")).alias("kind"), F.substring("statement", 1, most).alias("preview"))


def table_uses(files: DataFrame) -> DataFrame:
    """path, table_name (lower case) and relation; the files are read once."""
    found = [_found(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(p), 1)), "table_name", r) for r, p in TABLE_USES.items()]
    return files.select("path", F.explode(F.concat(*found)).alias("u")).select("path", "u.table_name", "u.relation").where(~F.col("table_name").isin(*NOT_TABLES))


def table_index(uses: DataFrame) -> DataFrame:
    """Per table: what is done with it, where, and the least path that creates it."""
    return uses.groupBy("table_name").agg(
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("operations"), F.count_distinct("path").alias("n_files"), F.min(F.when(F.col("relation") == "CREATES_TABLE", F.col("path"))).alias("defined_in")
    )


def hierarchy(files: DataFrame) -> DataFrame:
    """child, parent and relation of class heads."""
    heads = files.select(F.explode(F.regexp_extract_all("text", F.lit(r"(class\s+\w+[^{:\n]*)"), 1)).alias("head"))
    child = F.regexp_extract("head", r"class\s+(\w+)", 1).alias("child")
    told = {"EXTENDS": r"(?:extends\s+|\()([\w.]+(?:\s*,\s*[\w.]+)*)", "IMPLEMENTS": r"implements\s+([\w.]+(?:\s*,\s*[\w.]+)*)"}
    found = [_found(F.split(F.regexp_extract("head", p, 1), r"\s*,\s*"), "parent", r) for r, p in told.items()]
    return heads.select(child, F.explode(F.concat(*found)).alias("u")).select("child", "u.parent", "u.relation").where("parent <> ''")


def usages(files: DataFrame, share: int = 50_000) -> DataFrame:
    """Names that one file defines and another one mentions: an equi-join on words, not a search of each name in each text.

    What mentions a word is dealt over parts of some ``share`` rows and what defines it is repeated for each, so a common word has no
    single task; other words, nearly all, have one part. The join is by sort-merge: the files' sizes don't tell how many words they hold.
    """
    defined = matches(files, DEFINED, "name").withColumnRenamed("path", "source")
    words = matches(files, r"([A-Za-z_]\w*)", "name").withColumnRenamed("path", "target")
    common = words.groupBy("name").count().where(F.col("count") > share).select("name", F.ceil(F.col("count") / share).cast("int").alias("parts"))  # one of share rows at most
    parts = F.coalesce("parts", F.lit(1))
    words = words.join(F.broadcast(common), "name", "left").select("name", "target", F.pmod(F.xxhash64("target"), parts).cast("int").alias("salt"))
    defined = defined.join(F.broadcast(common), "name", "left").select("name", "source", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    return defined.hint("merge").join(words, ["name", "salt"]).where("source <> target").select("source", "target", "name")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.\w+)?$", 1)


def resolved_imports(files: DataFrame) -> DataFrame:
    """path and the file that each import names: its whole dotted path if there is one, else the least file of its last part's name."""
    spec = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"(?m)^(?:from|import)\s+([\w.]+)"), 1), F.regexp_extract_all("text", F.lit("from\\s+['\"]([^'\"]+)['\"]"), 1)))
    specs = files.select("path", F.explode(spec).alias("spec")).withColumn("wanted", F.regexp_replace(F.regexp_replace("spec", r"^(\.\.?/)+", ""), r"\.", "/"))
    known = files.select(F.col("path").alias("target"), F.regexp_replace("path", r"\.\w+$", "").alias("whole"), stem(F.col("path")).alias("base"))
    exact = specs.join(known, F.col("wanted") == F.col("whole")).select("path", "spec", "target", F.lit(1).alias("rank"))
    near = specs.join(known, stem(F.col("wanted")) == F.col("base")).select("path", "spec", "target", F.lit(2).alias("rank"))
    best = exact.unionByName(near).where("path <> target").groupBy("path", "spec").agg(F.min(F.struct("rank", "target")).alias("b"))
    return best.select("path", "spec", F.col("b.target").alias("target"), F.col("b.rank").alias("rank"))


def handlers(files: DataFrame, within: int = 4) -> DataFrame:
    """Routes and the first function that begins in the next lines of the same file: a bounded forward as-of by a window frame."""
    name = F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|function)?\s*([a-z_]\w*)\s*\(", 1)
    marked = lines(files).select("path", "line_no", F.nullif(F.regexp_extract("line", "@(?:\\w+\\.)?(?i:get|post|put|delete|patch)\\(\\s*['\"]([^'\"]*)['\"]", 1), F.lit("")).alias("route"), F.nullif(name, F.lit("")).alias("name"))
    ahead = Window.partitionBy("path").orderBy("line_no").rangeBetween(1, within)
    return marked.withColumn("handler", F.first("name", ignorenulls=True).over(ahead)).where("route is not null").select("path", "line_no", "route", "handler")


def brace_depth(files: DataFrame) -> DataFrame:
    """Depth of braces after each line."""
    delta = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    return lines(files).select("path", "line_no", F.sum(delta).over(Window.partitionBy("path").orderBy("line_no")).alias("depth"))


#: A CREATE TABLE up to its closing bracket, with brackets nested twice; and what begins a line that is no column.
DDL = r"(create\s+table\s+(?:if\s+not\s+exists\s+)?\w+\s*\([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+\))"
NO_COLUMN = r"^(?:primary|foreign|unique|constraint|check|index|key)\b"


def ddl_columns(files: DataFrame) -> DataFrame:
    """table_name, column_name, column_type and role (by its name) of CREATE TABLE statements; constraints are no columns."""
    t = files.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(DDL), 1)).alias("t"))
    body = F.regexp_extract("t", r"(?s)\((.*)\)$", 1)
    for _ in range(2):  # types lose their brackets, so that every comma left ends a column
        body = F.regexp_replace(body, r"\([^()]*\)", "")
    c = t.select(F.regexp_extract("t", r"table\s+(?:if\s+not\s+exists\s+)?(\w+)", 1).alias("table_name"), F.explode(F.split(body, ",")).alias("c")).withColumn("c", F.trim(F.regexp_replace("c", r"\s+", " ")))
    n = F.regexp_extract("c", r"^(\w+)", 1)
    real = c.where((F.col("c") != "") & ~F.col("c").rlike(NO_COLUMN))
    return real.select("table_name", n.alias("column_name"), F.regexp_extract("c", r"^\w+\s+(\w+)", 1).alias("column_type"), F.when(n == "id", "PK").when(n.endswith("_id"), "FK").otherwise("").alias("role"))


def stereotypes(files: DataFrame) -> DataFrame:
    """Classes and the annotation that stands before them."""
    both = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(@\w+\s+(?:public\s+)?class\s+\w+)"), 1)).alias("m"))
    return both.select("path", F.regexp_extract("m", r"class\s+(\w+)", 1).alias("name"), F.regexp_extract("m", r"@(\w+)", 1).alias("stereotype"))


def collection_uses(files: DataFrame) -> DataFrame:
    """Document collections and whether a call reads, writes or aggregates them."""
    both = matches(files, r"(db\.\w+\.\w+\()", "m").select("path", F.regexp_extract("m", r"db\.(\w+)", 1).alias("collection"), F.regexp_extract("m", r"\.(\w+)\($", 1).alias("call"))
    return both.select("path", "collection", F.when(F.col("call").rlike("^(insert|update|delete|replace)"), "WRITES").when(F.col("call") == "aggregate", "AGGREGATES").otherwise("READS").alias("use"))


def injected(files: DataFrame, comments: DataFrame) -> DataFrame:
    """Texts with each comment(path, line_no, comment) before its line; the other lines stay as they were."""
    own = lines(files).select("path", F.struct(F.col("line_no"), F.lit(1).alias("kind"), F.col("line")).alias("l"))
    added = comments.join(files.select("path"), "path", "left_semi").select("path", F.struct(F.col("line_no"), F.lit(0).alias("kind"), F.col("comment").alias("line")).alias("l"))
    return own.unionByName(added).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
