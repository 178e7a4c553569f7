"""Window-like operators: top-k per group, next rows, numbering, islands, latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def next_rows(df: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Consecutive pairs within a group: adds next_* and drops the last row."""
    w = Window.partitionBy(group).orderBy(*order)
    out = df
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.where(F.col(f"next_{columns[0]}").isNotNull())


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key, by an aggregate: partial results are combined before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("r")).select(key, *(f"r.{c}" for c in others))


def global_row_number(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds rn, the place in the order ``order`` of all rows, without a single task that sees them all.

    Rows are range-partitioned and numbered within their partition; the partitions' counts, one row
    for each, shift the numbers.
    """
    p = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from .graphs import cut

    p = cut(p)  # the partitions must be the same in both uses
    p = p.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    n = p.groupBy("_p").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return p.join(before, "_p").withColumn("rn", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def islands(df: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """Adds island: runs of rows of a group with the same ``kind``, from 1."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def numbered_within(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds place, from 0: where a row stands in its group by ``order``. All rows are numbered at once and shifted by their group's first number, so a large group is no single task's work."""
    p = global_row_number(df, [*group, *order])
    first = p.groupBy(*group).agg(F.min("rn").alias("_first"))
    return p.join(first, group).withColumn("place", F.col("rn") - F.col("_first")).drop("rn", "_first")
