"""Tables kept up to date by a stream of changes, with a manifest of partitions after each batch, and the states of jobs.

Each batch appends the rows that are its keys' latest, under its own number and committed by rename, so that a batch that runs
again after a failure puts the same rows in the same place. The table is the latest row of each key over all batches: late rows
lose by their own order, whatever batch brings them. ``compact`` folds the batches into one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregates import delta
from ..sources.graph_files import _fs, _whole


def _batches(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and "." not in n)


class Store:
    """A table of the latest row of each key, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str], partition: str, removed: str | None = None):
        """``order``: columns that tell the later of two rows; ``partition``: what the manifest counts by; ``removed``: a condition on rows that end their key."""
        self.spark, self.path, self.schema, self.key, self.order, self.partition, self.removed = spark, path.rstrip("/"), schema, key, order, partition, removed

    def latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != self.key]
        best = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(*self.order, *(c for c in others if c not in self.order))).alias("_r"))
        return best.select(self.key, *(f"_r.{c}" for c in others)).select(*rows.columns)

    def put(self, batch: DataFrame, number: int) -> None:
        """Append a batch and write the manifest of the table after it, with what has changed since the one before."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        _whole(self.spark, f"{self.path}/changes/batch={number}", lambda at: self.latest(batch.select(*columns)).write.parquet(at))
        _whole(self.spark, f"{self.path}/manifest/batch={number}", lambda at: self.manifest_of(self.table(number)).write.parquet(at))

    def table(self, until: int | None = None) -> DataFrame:
        """The table after batch ``until`` (or the last one)."""
        numbers = [n for n in _batches(self.spark, f"{self.path}/changes") if until is None or n <= until]
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/changes/batch={n}" for n in numbers))
        now = self.latest(rows)
        return now.where(f"NOT coalesce({self.removed}, false)") if self.removed else now

    def manifest_of(self, table: DataFrame) -> DataFrame:
        """partition, node_count, content_hash: sums of row hashes, which add up in any order."""
        h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*table.columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
        p = table.groupBy(F.coalesce(F.col(self.partition).cast("string"), F.lit("__default__")).alias("partition")).agg(F.count("*").alias("node_count"), F.sum(h).alias("s"))
        return p.select("partition", "node_count", F.substring(F.sha2(F.concat_ws("|", "partition", "node_count", "s"), 256), 1, 16).alias("content_hash"))

    def manifest(self, until: int | None = None) -> DataFrame:
        numbers = [n for n in _batches(self.spark, f"{self.path}/manifest") if until is None or n <= until]
        if not numbers:
            return self.spark.createDataFrame([], "partition string, node_count long, content_hash string")
        return self.spark.read.parquet(f"{self.path}/manifest/batch={numbers[-1]}")

    def changed(self, since: int, until: int | None = None) -> DataFrame:
        """partition, state (added, removed, changed, unchanged) between the manifests of two batches."""
        return delta(self.manifest(since), self.manifest(until))

    def compact(self) -> None:
        """Fold all batches into the last one's place; rows that end their key stay, for late rows must still lose to them."""
        numbers = _batches(self.spark, f"{self.path}/changes")
        if len(numbers) < 2:
            return
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/changes/batch={n}" for n in numbers))
        _whole(self.spark, f"{self.path}/changes/batch={numbers[-1]}", lambda at: self.latest(rows).write.parquet(at))
        for n in numbers[:-1]:  # until they are gone, the table is the same with them
            fs, at = _fs(self.spark, f"{self.path}/changes/batch={n}")
            fs.delete(at, True)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Put all that the stream has by now, a micro-batch at a time."""
        q = stream.writeStream.foreachBatch(lambda df, n: self.put(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


#: What an event makes of a job; the last two end it.
JOB_STATES = {"signup": "queued", "view": "running", "click": "running", "purchase": "done", "error": "failed"}
ENDED = ("done", "failed", "timed_out")
JOB = "job_id long, state string, at_us long, n_events long"


def job_states(events: DataFrame, timeout_days: int = 30, late: str = "1 day") -> DataFrame:
    """job_id, state, at_us, n_events: a job's state after each micro-batch that has events of it, and once more when it times out.

    The state is that of the latest event by (time, event_id) that the job has seen; a job that hasn't ended and that the watermark passes
    by ``timeout_days`` is timed out, and alive again with its next event.
    """
    wait = timeout_days * 86_400_000

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ident, kind, n = state.get if state.exists else (-1, -1, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "state": ["timed_out"], "at_us": [at], "n_events": [n]})
            return
        for f in frames:
            n += len(f)
            for t, i, k in zip(f["us"], f["event_id"], f["event_type"]):
                if (t, i) > (at, ident):
                    at, ident, kind = int(t), int(i), k
        now = JOB_STATES.get(kind, "running")
        state.update((at, ident, kind, n))
        if now not in ENDED:
            state.setTimeoutTimestamp(max(at // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "at_us": [at], "n_events": [n]})

    from ..session import ship

    ship(events.sparkSession)
    e = events.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    e = e.select("user_id", "ts", "event_id", "event_type", F.unix_micros("ts").alias("us"))
    return e.groupBy("user_id").applyInPandasWithState(step, JOB, "at long, ident long, kind string, n long", "update", GroupStateTimeout.EventTimeTimeout)
