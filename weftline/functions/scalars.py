"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that code counts as special in the token estimate.
SPECIAL = r"[{}\[\]()=<>:;,./\\|@#$%^&*~`]"
# Words of three letters or more that carry no signal.
STOP_WORDS = (
    "the and for with this that from are was were has have been not but all can had her his its may new now old see way who"
    " did get let say she too use which each other into some than them then these such only also"
).split()


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "^_+|_+$", "")


def node_id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("__", F.lit(prefix), *(slug(p) for p in parts))


def canonical(c: Column) -> Column:
    """camelCase and PascalCase to snake_case."""
    c = F.regexp_replace(c, "^_+|_+$", "")
    c = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.regexp_replace(F.lower(c), "_+", "_")


def route(c: Column) -> Column:
    """A path without method, query, fragment and trailing slash, with {} for its parameters."""
    c = F.regexp_replace(c, "^(GET|POST|PUT|DELETE|PATCH) +", "")
    c = F.regexp_replace(c, r"[?#].*$", "")
    c = F.regexp_replace(c, r"\$?\{[^}]*\}|:[A-Za-z_]+|<[^>]*>", "{}")
    return F.regexp_replace(c, "/+$", "")


def url_path(c: Column) -> Column:
    return F.regexp_replace(c, "^[a-z]+://[^/]*", "")


def statement_kind(c: Column) -> Column:
    first = F.upper(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(first.isin("CREATE", "ALTER", "DROP", "TRUNCATE"), "DDL").when(first.isin("INSERT", "UPDATE", "DELETE", "MERGE"), "DML").otherwise("QUERY")


def collapse(c: Column, width: int) -> Column:
    """One space between words, cut at a word's end with an ellipsis."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.regexp_extract(F.substring(c, 1, width), r"^(.*) ", 1), F.lit("…")))


def clean(c: Column, most: int) -> Column:
    """Without control characters, cut with an ellipsis."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def first_lines(c: Column, n: int) -> Column:
    lines = F.split(c, "\n")
    more = F.size(lines) - n
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... "), more.cast("string"), F.lit(" more lines"))).otherwise(c)


def http_method(c: Column) -> Column:
    """By the first keyword that a name has."""
    # Keywords of each method, in order.
    rules = [("POST", "create|register|add|post"), ("PUT", "update|edit|put|modify"), ("DELETE", "delete|remove"), ("PATCH", "patch")]
    c, out = F.lower(c), None
    for method, words in rules:
        out = F.when(c.rlike(words), method) if out is None else out.when(c.rlike(words), method)
    return out.otherwise("GET")


def tier(node_type: Column) -> Column:
    return F.when(node_type.isin("REGION", "NATION"), "Reference").when(node_type.isin("CUSTOMER", "SUPPLIER"), "Party").when(node_type == "PART", "Catalogue").otherwise("Transaction")


def sensitivity(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike("customer|user|account"), "Confidential").when(n.rlike("order|supplier"), "Internal").otherwise("Public")


def signals(c: Column) -> Column:
    """Distinct words of three letters or more, without stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), 1), lambda w: ~w.isin(*STOP_WORDS))))


def estimate_tokens(c: Column) -> Column:
    words = F.size(F.regexp_extract_all(c, F.lit(r"(\S+)"), 1))
    return F.floor(words * 1.3) + F.floor(F.regexp_count(c, F.lit(SPECIAL)) * 0.3)


def budget_share(weight: Column, total: Column, budget: int) -> Column:
    return F.floor(weight * budget / total)


def duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    rest = F.pmod(s, F.lit(60))
    text = F.when(h > 0, F.format_string("%dh %dm %ds", h, m, rest)).when(m > 0, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))
    return F.when(seconds.isNull(), F.lit("—")).otherwise(text)


def safe_id(c: Column) -> Column:
    c = F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("n"), c)).otherwise(c)


def tags(c: Column, table: dict[str, list[str]]) -> Column:
    """Names of the table's entries of which a keyword occurs in the text, sorted."""
    c = F.lower(c)
    hit = [F.when(F.greatest(*(F.contains(c, F.lit(k)).cast("int") for k in words), F.lit(0)) > 0, F.lit(name)) for name, words in sorted(table.items())]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())
