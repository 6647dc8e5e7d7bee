"""A journal in a shared folder, written in whole batches, each chained to the one before.

    journal/<number>-<uuid>/rows, heads     a batch: its events with their hashes, and the heads of its segments
    commits/<number>.json                   one short line a batch: where it lies, its size and its place in the chain

A batch is written to a folder of its own first and counts only once its commit file is there. That file is created exclusively under the next
number: of two writers that saw the same head, one gets the number and the other is refused, with nothing of its batch ever read. A writer that
is killed leaves a folder that no commit names. Hashes are stored with the events, so that an audit compares two things: what was written
then, and what is there now.

Within a batch, events are chained by segments side by side (``journal.chained``); segments are chained in the batch, batches by their commits:
the sequential part is one short row a segment.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import journal as J


class Taken(RuntimeError):
    """Another writer has published since the head was read."""


def _hash(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


class Store:
    """Batches of events. ``schema`` names the columns of an event besides seq; ``payload`` makes an event's hash from them."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, payload: Callable[[], Column], segment: int = J.SEGMENT) -> None:
        self.spark, self.folder, self.schema, self.payload, self.segment = spark, folder.rstrip("/"), schema, payload, segment
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- commits

    def commits(self) -> list[dict]:
        """The published batches in order: one short row each. A commit file without its line (its writer was killed) counts as none."""
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at) or not self._fs.listStatus(at):
            return []
        lines = self.spark.read.schema("number long, path string, n long, first_seq long, last_seq long, count long, own_head string, prev_head string, head string").json(f"{self.folder}/commits")
        return sorted((r.asDict() for r in lines.where("number is not null").collect()), key=lambda c: c["number"])

    def _publish(self, commit: dict) -> None:
        target = self._path(f"{self.folder}/commits/{commit['number']:012d}.json")
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            if self._fs.exists(target):
                raise Taken(f"batch {commit['number']} was published by another writer") from e
            raise
        out.write((json.dumps(commit) + "\n").encode())
        out.close()

    # -- rows

    def read(self, commits: list[dict] | None = None) -> DataFrame:
        """The events of all published batches, or of those given, with ``seq`` and their stored hashes."""
        commits = self.commits() if commits is None else commits
        schema = f"{self.schema}, seq long, batch long, segment long, payload_hash string, prev_hash string, event_hash string"
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{c['path']}/rows" for c in commits))

    def append(self, rows: DataFrame, seen: list[dict]) -> dict | None:
        """Publishes ``rows`` (event columns and a seq that follows the last one) after the commits in ``seen``; None without rows.

        Raises ``Taken`` if another batch was published meanwhile: read again and retry.
        """
        last = seen[-1] if seen else {"number": 0, "count": 0, "head": "", "last_seq": 0}
        number = last["number"] + 1
        path = f"journal/{number:012d}-{uuid.uuid4().hex}"
        # Numbering and hashes are settled before the rows are hashed: one written table feeds both.
        rows.withColumn("payload_hash", self.payload()).write.parquet(f"{self.folder}/{path}/staged")
        staged = self.spark.read.parquet(f"{self.folder}/{path}/staged")
        chain = J.chained(staged.select(F.lit(str(number)).alias("project_id"), "seq", "payload_hash"), self.segment, F.col("payload_hash"))
        hashed = staged.join(chain.select("seq", "segment", "prev_hash", "event_hash"), "seq").withColumn("batch", F.lit(number).cast("long"))
        hashed.write.parquet(f"{self.folder}/{path}/rows")
        self._fs.delete(self._path(f"{self.folder}/{path}/staged"), True)
        stored = self.spark.read.parquet(f"{self.folder}/{path}/rows")
        size = stored.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).first()
        if not size["n"]:
            self._fs.delete(self._path(f"{self.folder}/{path}"), True)
            return None
        J.segment_heads(stored.withColumn("project_id", F.col("batch").cast("string"))).write.parquet(f"{self.folder}/{path}/heads")
        own = self._own_head(path)
        commit = {"number": number, "path": path, "n": size["n"], "first_seq": size["a"], "last_seq": size["b"], "count": last["count"] + size["n"], "own_head": own, "prev_head": last["head"]}
        commit["head"] = _hash(last["head"], number, commit["count"], own)
        self._publish(commit)
        return commit

    def delete(self, name: str) -> None:
        """Removes a folder of the store, if it is there."""
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def replace(self, commit: dict, rows: DataFrame) -> None:
        """Puts other rows in a batch's place, without its hashes: what an audit is there to find. For tests of a store's audit."""
        path = f"{self.folder}/{commit['path']}"
        rows.write.parquet(f"{path}/other")
        self._fs.delete(self._path(f"{path}/rows"), True)
        self._fs.rename(self._path(f"{path}/other"), self._path(f"{path}/rows"))

    def _own_head(self, path: str) -> str:
        return self.spark.read.parquet(f"{self.folder}/{path}/heads").agg(F.max_by("head", "segment")).first()[0] or ""

    # -- audit

    def audit(self) -> DataFrame:
        """``batch, problem, n``: everything that doesn't agree with what was stored; no rows if all does.

        ``payload``: events whose content no longer gives their hash; ``chain``: events and segment heads whose stored hashes don't follow one
        another, or are missing; ``size``, ``gap``: events lost or added, numbers missing; ``head``, ``commit``: a batch that doesn't follow the one before.
        """
        commits = self.commits()
        found: list[tuple[int, str, int]] = []
        before = {"number": 0, "count": 0, "head": "", "last_seq": 0}
        for c in commits:  # one short row a batch
            if c["number"] != before["number"] + 1 or c["prev_head"] != before["head"] or c["count"] != before["count"] + c["n"]:
                found.append((c["number"], "commit", 1))
            if c["head"] != _hash(c["prev_head"], c["number"], c["count"], c["own_head"]):
                found.append((c["number"], "head", 1))
            before = c
        problems = self.spark.createDataFrame(found, "batch long, problem string, n long")
        if not commits:
            return problems
        rows = self.read(commits)
        per = rows.withColumn("changed", ~F.coalesce(F.col("payload_hash") == self.payload(), F.lit(False))).groupBy("batch").agg(
            F.sum(F.col("changed").cast("long")).alias("payload"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.count_distinct("seq").alias("numbers")
        )
        told = self.spark.createDataFrame([(c["number"], c["n"], c["first_seq"], c["last_seq"], c["own_head"]) for c in commits], "batch long, told long, first long, last long, own string")
        heads = self.spark.read.schema("project_id string, segment long, n long, last_hash string, prev_head string, head string").parquet(*(f"{self.folder}/{c['path']}/heads" for c in commits))
        chain = J.audit(rows.withColumn("project_id", F.col("batch").cast("string")), heads).select(F.col("project_id").cast("long").alias("batch"), F.col("broken").alias("chain"))
        tops = heads.groupBy(F.col("project_id").cast("long").alias("batch")).agg(F.max_by("head", "segment").alias("top"))
        every = told.join(per, "batch", "left").join(chain, "batch", "left").join(tops, "batch", "left").na.fill(0, ["n", "payload", "chain", "numbers"])
        tests = {
            "payload": F.col("payload"),
            "chain": F.col("chain"),
            "size": F.abs(F.col("n") - F.col("told")),
            "gap": F.col("last") - F.col("first") + 1 - F.col("numbers"),
            "head": F.when(F.coalesce(F.col("top") == F.col("own"), F.lit(False)), 0).otherwise(1).cast("long"),
        }
        stacked = every.select("batch", F.explode(F.array(*(F.struct(F.lit(k).alias("problem"), v.cast("long").alias("n")) for k, v in tests.items()))).alias("x")).select("batch", "x.problem", "x.n")
        return problems.union(stacked.where("n <> 0"))
