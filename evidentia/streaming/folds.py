"""The failure fold as a stream: each micro-batch writes its partial folds, and their merge equals a rebuild over the whole journal.

A batch writes to a folder of its own number in overwrite mode, so that a batch that is tried again replaces itself: exactly once,
whatever fails. Partial folds are sums, minima, maxima and first-by-seq values, which merge in any order: late events are never
dropped, and order inside a batch doesn't matter. Progress is the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: State on the executors' disks, with changes alone written to the checkpoint: a batch costs what it holds.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def partial_fold(events: DataFrame) -> DataFrame:
    """Sums of one batch; an event that stands in it twice counts once."""
    failed = events.where(F.col("event_type") == "verification.failed").dropDuplicates(["event_id"])
    return failed.groupBy("project_id", "signature").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("seq", "event_id", "command", "error_kind")).alias("first"), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"))


def merged_fold(partials: DataFrame) -> DataFrame:
    rows = partials.groupBy("project_id", "signature").agg(F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return rows.select("project_id", "signature", "first.event_id", "first.command", "first.error_kind", "occurrences", "first_seen", "last_seen")


def each_once(events: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a stream that gives ``take`` every event once, whatever batch it comes in again: the ids are keyed state, and a batch looks up its own alone."""
    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        writer = events.dropDuplicates(["event_id"]).writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:  # a started stream keeps the settings it was started with
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_fold(events: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A query that folds a stream of journal rows; an event that is sent again counts once."""

    def fold(batch: DataFrame, number: int) -> None:
        partial_fold(batch).write.mode("overwrite").parquet(f"{folder}/partials/batch={number}")

    return each_once(events, fold, checkpoint, once)


def folded(spark: SparkSession, folder: str) -> DataFrame:
    """The fold of all batches so far."""
    return merged_fold(spark.read.parquet(f"{folder}/partials"))


def bursts(calls: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """``client, burst, n, started, ended`` of refused calls: a burst ends where the next call is more than the gap away."""
    w = Window.partitionBy("client").orderBy("at", "call_id")
    far = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp")) > gap_seconds * 1_000_000
    rows = calls.withColumn("starts", F.coalesce(far, F.lit(True)).cast("long")).withColumn("burst", F.sum("starts").over(w))
    return rows.groupBy("client", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("started"), F.max("at").alias("ended"))


def rate_limited(calls: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """``client, call_id, allowed``: at most ``limit`` allowed calls in the trailing seconds; refused ones don't count.

    Whether a call counts depends on all before it, so a client's calls stream in order past a queue of at most ``limit`` times.
    """
    from collections import deque

    import pyarrow as pa

    def run(batches):
        client, times = None, deque()
        for batch in batches:
            out = []
            for c, at in zip(batch.column("client").to_pylist(), batch.column("micros").to_pylist(), strict=True):
                if c != client:
                    client, times = c, deque()
                while times and times[0] <= at - seconds * 1_000_000:
                    times.popleft()
                out.append(len(times) < limit)
                if out[-1]:
                    times.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("call_id"), pa.array(out, pa.bool_())], ["client", "call_id", "allowed"])

    rows = calls.select("client", "call_id", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    return rows.repartition("client").sortWithinPartitions("client", "micros", "call_id").mapInArrow(run, "client string, call_id long, allowed boolean")
