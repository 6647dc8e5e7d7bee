"""All projections of a journal as one stream: a batch costs what it holds, not what came before, and reading equals a rebuild.

The ids of all events are keyed state of the stream (``dropDuplicates`` over a RocksDB store): an event that is sent again, in whatever batch, counts
once, and a batch looks up its own ids alone. What is left of a batch goes to folders of its number:

    failures, performance    sums, minima and first-by-seq values by key, which merge in any order
    records, turns           the records that the events make, and the reviews, landings, reverts and rejected branches that change them
    done/<number>            written last; what has no such mark is not read
    base/<number>            marks folds of all batches up to that one, merged by ``compact``

A batch that is tried again starts from the same state, so that it writes the same rows over its own folders: exactly once, whatever fails. Events may come
late and in any order. That is why a record's life is not settled in the stream: a late revert may end it before a landing that is already counted. ``lives`` joins kept
records and turns instead and never reads the journal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators import projections
from evidentia.streaming.folds import each_once, merged_fold, partial_fold

# Events that change records of others.
TURNS = ("review.approved", "review.rejected", "review.changes_requested", "integration.landed", "integration.reverted", "branch.rejected")
TURN_COLUMNS = ("seq", "event_type", "source", "project_id", "task_id", "branch", "target", "commit_sha", "reviewer", "recorded_at")
AGENT = ("project_id", "agent_profile", "adapter")
COUNTS = ("attempts", "successes", "verifications", "approvals")


def partial_performance(events: DataFrame) -> DataFrame:
    """Attempts, successes, verifications and approvals of each agent in a batch, and when it was seen."""
    kind = F.col("event_type")

    def count(p: Column) -> Column:
        return F.sum(F.coalesce(p, F.lit(False)).cast("long"))

    rows = events.where(kind.isin("attempt.completed", "verification.passed", "verification.failed", "review.approved"))
    counts = (count(kind == "attempt.completed"), count((kind == "attempt.completed") & F.col("ok")), count(kind.startswith("verification.")), count(kind == "review.approved"))
    return rows.groupBy(*AGENT).agg(*(c.alias(n) for c, n in zip(counts, COUNTS, strict=True)), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"))


def merged_performance(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*AGENT).agg(*(F.sum(c).alias(c) for c in COUNTS), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merged_failures(partials: DataFrame) -> DataFrame:
    return partials.groupBy("project_id", "signature").agg(F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


MERGES = {"failures": merged_failures, "performance": merged_performance}


class Projection:
    """The projections in ``folder``, which driver and executors share. One stream writes to it at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- writing

    def start(self, events: DataFrame, once: bool = True) -> StreamingQuery:
        """Projects a stream of journal rows: ``event_id`` and the columns of ``projections.project``, ``projections.lives`` and ``journal.performance``.

        Rows without an ``event_id`` are all taken for one event. The number of state partitions is that of shuffle partitions at the first start.
        """
        return each_once(events, self._take, f"{self.folder}/checkpoint", once)

    def _take(self, batch: DataFrame, number: int) -> None:
        # The state is asked once: all tables come from one written one, which the next batch writes over.
        staged = f"{self.folder}/staged"
        batch.write.mode("overwrite").parquet(staged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        parts = {"failures": partial_fold(rows), "performance": partial_performance(rows), "records": projections.project(rows), "turns": rows.where(F.col("event_type").isin(*TURNS)).select(*TURN_COLUMNS)}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        self._mark("done", number)

    def _mark(self, kind: str, number: int) -> None:
        self._fs.create(self._path(f"{self.folder}/{kind}/{number:012d}"), True).close()

    def _last(self, kind: str) -> int:
        """The highest number with a mark, -1 without any."""
        at = self._path(f"{self.folder}/{kind}")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(at)), default=-1) if self._fs.exists(at) else -1

    def compact(self) -> int:
        """Merges the folds of all finished batches, so that later reads meet one part for them; returns the last batch in it."""
        last = self._last("done")
        if last > self._last("base"):
            for name, merge in MERGES.items():
                merge(self._parts(name)).write.mode("overwrite").parquet(f"{self.folder}/merged/{name}-{last:012d}")
            self._mark("base", last)
        return last

    # -- reading

    def _batches(self, name: str, after: int = -1) -> DataFrame | None:
        last = self._last("done")
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").where(F.col("batch").between(after + 1, last)).drop("batch") if last > after else None

    def _parts(self, name: str) -> DataFrame:
        base = self._last("base")
        kept = self.spark.read.parquet(f"{self.folder}/merged/{name}-{base:012d}") if base >= 0 else None
        fresh = self._batches(name, base)
        if kept is None and fresh is None:
            raise ValueError("no batch is finished yet")
        return kept if fresh is None else fresh if kept is None else kept.unionByName(fresh)

    def failures(self) -> DataFrame:
        """The failure fold of all finished batches."""
        return merged_fold(self._parts("failures"))

    def performance(self) -> DataFrame:
        """Attempts, successes, verifications, approvals and the success rate of each agent."""
        rows = merged_performance(self._parts("performance"))
        return rows.withColumn("success_rate", F.when(F.col("attempts") > 0, F.bround(F.col("successes") / F.col("attempts"), 4)))

    def lives(self) -> DataFrame:
        """All records after all later events: ``projections.lives`` of the whole journal."""
        records, turns = self._batches("records"), self._batches("turns")
        if records is None:
            raise ValueError("no batch is finished yet")
        return projections.lives(records, turns)
