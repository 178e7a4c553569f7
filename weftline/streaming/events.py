"""Structured Streaming over the events table: windowed counts with a watermark, and the latest state per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared
from ..sources.graph_files import _whole
from .incremental import _batches

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The files in ``folder`` whose names match, as a stream."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def latest_state(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"))


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """What the stream gives by now: in complete mode the last result, else the rows of all micro-batches, with the number of each as ``batch``.

    Each micro-batch is written to the shared folder and committed by rename, so one that runs again replaces itself.
    """
    spark, path = df.sparkSession, shared(df.sparkSession, "stream")

    def put(rows: DataFrame, n: int) -> None:
        _whole(spark, f"{path}/rows/batch={n}", lambda at: rows.write.parquet(at))

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not _batches(spark, f"{path}/rows"):
        return spark.createDataFrame([], df.schema).withColumn("batch", F.lit(0))
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/rows")
    if mode != "complete":
        return rows
    return rows.where(F.col("batch") == _batches(spark, f"{path}/rows")[-1]).drop("batch")
