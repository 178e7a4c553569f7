"""Contexts cut down to a token budget, each inside its own row: by halving in steps, and section by section by priority.

Items carry their words and special characters, so that a section's estimate is a sum over what is left of it and no text is
put together to be counted. The estimate of a whole is that of its items one after the other, white space between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the estimate counts as special, as in functions.scalars.SPECIAL.
SPECIAL = "{}[]()=<>:;,./\\|@#$%^&*~`"

# Sections from the first to be trimmed to the last.
TRIM_ORDER = ["semantic_neighbors", "relationships", "related_functions", "telecom", "business", "workflow", "lineage", "architecture", "target", "source_code"]


def item(text: Column) -> Column:
    """text with its number of words and of special characters."""
    special = F.length(text) - F.length(F.translate(text, SPECIAL, ""))
    return F.struct(text.alias("text"), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("words"), F.coalesce(special, F.lit(0)).cast("long").alias("special"))


def items(texts: Column) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), item)


def _sum(a: Column) -> Column:
    """words and special of items in one pass."""
    zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("special"))
    return F.aggregate(F.coalesce(a, F.array().cast("array<struct<text:string,words:bigint,special:bigint>>")), zero, lambda x, y: F.struct((x["words"] + y["words"]).alias("words"), (x["special"] + y["special"]).alias("special")))


def estimate(words: Column, special: Column) -> Column:
    return F.floor(words * 1.3) + F.floor(special * 0.3)


def _whole(sections: list[str]) -> Column:
    return estimate(*(sum((F.col(f"_n_{s}.{c}") for s in sections), F.lit(0)) for c in ("words", "special")))


def _counted(x: DataFrame, sections: list[str]) -> DataFrame:
    """The counts of sections in columns of their own: of one struct's fields Spark would count all anew for each use."""
    return x.withColumns({f"_n_{s}": _sum(F.col(s)) for s in sections})


def _fitting(section: str, sizes: Column, rest: Column, budget: Column) -> Column:
    """The first of ``sizes`` that brings the whole, ``rest`` being all but the section, under the budget. Sizes halve, so that all of them count twice the items at most."""

    def fits(k: Column) -> Column:
        n = _sum(F.slice(section, F.lit(1), k))
        return F.aggregate(F.array(n), F.lit(False), lambda _, c: estimate(rest["words"] + c["words"], rest["special"] + c["special"]) <= budget)

    return F.get(F.filter(sizes, fits), F.lit(0))


def _halvings(first: Column, most: Column) -> Column:
    """first, half of it and so on, those over ``most``; a list of any length has fewer than 31."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.floor(first / F.pow(F.lit(2), i)).cast("int")), lambda k: k > most)


def _rest(section: str, sections: list[str]) -> Column:
    return F.struct(*(sum((F.col(f"_n_{s}.{c}") for s in sections if s != section), F.lit(0)).alias(c) for c in ("words", "special")))


def compressed(contexts: DataFrame, budget: int | str) -> DataFrame:
    """Contexts (head, neighbours, edges, related, source: arrays of items) with what fits ``budget``, a number or a column; adds tokens and truncated.

    Over budget, neighbours are halved (from half of them, five at least, while more than three are to stay), then edges (from half, ten at least,
    down to five), then related functions are cut to three, then the source to half its lines, twenty at least. What is still over stays so.
    """
    limit = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    sections = ["head", "neighbours", "edges", "related", "source"]
    x = _counted(contexts, sections)
    over = lambda: _whole(sections) > limit
    for section, low, least in (("neighbours", 5, 3), ("edges", 10, 5)):
        sizes = _halvings(F.greatest(F.lit(low), F.floor(F.size(section) / 2)), F.lit(least))
        x = x.withColumn("_k", F.when(over(), sizes)).withColumn("_r", _rest(section, sections))
        x = x.withColumn("_k", F.when(F.col("_k").isNotNull(), F.coalesce(_fitting(section, F.col("_k"), F.col("_r"), limit), F.try_element_at("_k", F.lit(-1)))))
        x = _counted(x.withColumn(section, F.when(F.col("_k").isNull(), F.col(section)).otherwise(F.slice(section, F.lit(1), F.coalesce("_k", F.lit(0))))), [section])
    x = _counted(x.withColumn("related", F.when(over(), F.slice("related", 1, 3)).otherwise(F.col("related"))), ["related"])
    half = F.greatest(F.lit(20), F.floor(F.size("source") / 2)).cast("int")
    x = x.withColumn("truncated", over() & (F.size("source") > 0))
    x = x.withColumn("source", F.when(F.col("truncated"), F.concat(F.slice("source", F.lit(1), half), F.array(item(F.lit("... [truncated]"))))).otherwise(F.col("source")))
    return _counted(x, ["source"]).withColumn("tokens", _whole(sections)).drop("_k", "_r", *(f"_n_{s}" for s in sections))


def trimmed(contexts: DataFrame, budget: int, order: list[str] | None = None) -> DataFrame:
    """Contexts whose sections, arrays of items, are trimmed one after the other in ``order`` until the whole fits ``budget``; adds tokens.

    A list of more than two is halved while over budget and more than one is left; a section that doesn't bring the whole under
    the budget is left out (null). Sections that ``order`` doesn't name stay; null sections count nothing.
    """
    order = [s for s in (order or TRIM_ORDER) if s in contexts.columns]
    others = [c for c, t in contexts.dtypes if t.startswith("array<struct<text:")]
    x = _counted(contexts, others)
    limit = F.lit(budget)
    for s in order:
        sizes = F.when(F.size(s) > 2, _halvings(F.floor(F.size(s) / 2), F.lit(0))).otherwise(F.array().cast("array<int>"))
        x = x.withColumn("_over", _whole(others) > budget).withColumn("_r", _rest(s, others))
        x = x.withColumn("_k", F.when(F.col("_over") & F.col(s).isNotNull(), sizes))
        x = x.withColumn("_k", F.when(F.size("_k") > 0, _fitting(s, F.col("_k"), F.col("_r"), limit)))
        x = _counted(x.withColumn(s, F.when(~F.col("_over"), F.col(s)).when(F.col("_k").isNotNull(), F.slice(s, F.lit(1), F.coalesce("_k", F.lit(0))))), [s])
    return x.withColumn("tokens", _whole(others)).drop("_k", "_r", "_over", *(f"_n_{s}" for s in others))
