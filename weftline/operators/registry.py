"""An ordered list of rules that add edges, where one rule's failure is kept as data and stops no other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

EDGE = "from_id string, to_id string, relation string"


@dataclass
class Rules:
    """Rules by name, in the order in which they were registered; each makes edges (from_id, to_id, relation) of a context."""

    found: dict[str, Callable[[Any], DataFrame]] = field(default_factory=dict)

    def rule(self, name: str):
        if name in self.found:
            raise ValueError(f"a rule is named {name} already")

        def put(f):
            self.found[name] = f
            return f

        return put

    def run(self, spark: SparkSession, context: Any) -> tuple[DataFrame, DataFrame]:
        """Edges (from_id, to_id, relation, rule), each once by its first rule, and outcomes (position, rule, edges, error).

        Every rule's edges are written before the next rule runs: what fails in planning or in a task fails there, and a failed
        rule leaves no part of its edges.
        """
        parts, outcomes = [], []
        for i, (name, f) in enumerate(self.found.items()):
            try:
                rows = f(context).select("from_id", "to_id", "relation")
                part = written(rows.distinct().withColumn("_i", F.lit(i)).withColumn("rule", F.lit(name)), f"rule-{i}")
                parts.append(part)
                outcomes.append((i, name, part.count(), None))
            except (PySparkException, ValueError, TypeError, KeyError, AttributeError) as e:
                outcomes.append((i, name, 0, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]))
        report = spark.createDataFrame(outcomes, "position int, rule string, edges long, error string")
        if not parts:
            return spark.createDataFrame([], EDGE + ", rule string"), report
        all_ = reduce(DataFrame.unionByName, parts)
        return all_.groupBy("from_id", "to_id", "relation").agg(F.min_by("rule", "_i").alias("rule")), report
