"""Facts over time: which fact a change replaces, which facts contradict each other on arrival, and what was current when.

A subject's facts stream in the order of the journal past a window of its newest current facts. A fact that changes ends the newest current one on its
subject that says something else; a fact that is only observed contradicts the current ones in its place that say something else. A change ends at
most one fact and adds itself, so that a fact that has left the window never comes back into it: a subject costs memory for the window alone, however
many facts it has, and a fact meets at most a window of others. It does take one task in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how many of a subject's newest current facts an arriving one meets.
CANDIDATES = 50


def _until(facts: DataFrame) -> Column:
    return F.col("until").cast("long") if "until" in facts.columns else F.lit(None).cast("long")


def arrivals(facts: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """``memory_id, seq, project_id, subject_key, supersedes_id, contradicts`` of every fact with a subject: what it met when it arrived.

    facts: ``memory_id, seq, project_id, repository_id, branch, subject_key, statement, changes`` and perhaps ``until``, the seq at which something else
    (a revert, a rejected branch, a withdrawal) ended the fact; a fact ended so still leaves the place in the window that newer facts took from older ones.
    ``memory_id`` names one fact. Equal statements neither replace nor contradict each other; places are equal if repository and branch are, nulls included. Facts
    with equal seq go by memory_id; a null ``changes`` counts as observed; facts without a subject meet none and leave no row. Statements travel as hashes, whatever their length.
    """
    said = F.coalesce(F.sha2(F.col("statement").cast("string"), 256), F.lit(""))
    place = F.to_json(F.struct("repository_id", "branch"))
    rows = facts.where(F.coalesce("subject_key", F.lit("")) != "").select("memory_id", F.col("seq").cast("long").alias("seq"), "project_id", "subject_key", said.alias("said"), place.alias("place"), F.coalesce("changes", F.lit(False)).alias("changes"), _until(facts).alias("until"))
    rows = rows.repartition("project_id", "subject_key").sortWithinPartitions("project_id", "subject_key", "seq", "memory_id")
    names = rows.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current = None, deque()
        for batch in batches:
            replaced, met = [], []
            for memory_id, seq, project, subject, said, place, changes, until in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (project, subject) != key:
                    key, current = (project, subject), deque()
                if any(c[3] is not None and c[3] <= seq for c in current):
                    current = deque(c for c in current if c[3] is None or c[3] > seq)
                others = [c for c in reversed(current) if c[1] != said]
                old = others[0] if changes and others else None
                if old is not None:
                    current.remove(old)
                replaced.append(old and old[0])
                met.append([] if changes else [c[0] for c in others if c[2] == place])
                if until is None or until > seq:
                    current.append((memory_id, said, place, until))
                if len(current) > candidates:
                    current.popleft()
            kind = batch.column("memory_id").type
            kept = [batch.column(c) for c in names[:4]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(replaced, kind), pa.array(met, pa.list_(kind))], [*names[:4], "supersedes_id", "contradicts"])

    shape = rows.select(*names[:4], F.lit(None).cast(rows.schema["memory_id"].dataType).alias("supersedes_id")).withColumn("contradicts", F.array("supersedes_id"))
    return rows.mapInArrow(fold, shape.schema)


def superseded(met: DataFrame) -> DataFrame:
    """``memory_id, superseded_by, superseded_at`` of the facts that a change has replaced, from ``arrivals``; each is replaced once."""
    return met.where("supersedes_id is not null").select(F.col("supersedes_id").alias("memory_id"), F.col("memory_id").alias("superseded_by"), F.col("seq").alias("superseded_at"))


def validity(facts: DataFrame, met: DataFrame) -> DataFrame:
    """Facts with ``superseded_by`` and ``ended``: the first seq at which they were no longer current, null if they still are."""
    gone = superseded(met)
    rows = facts.withColumn("_until", _until(facts)).join(gone, "memory_id", "left")
    # least skips nulls.
    return rows.withColumn("ended", F.least("_until", "superseded_at")).drop("_until", "superseded_at")


def current_at(valid: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` rows (``project_id, subject_key, seq`` and more) with ``n_current``, the facts on the subject that were current at that seq.

    Beginnings, ends and questions of a subject stand in one sequence with a running sum: a question costs a row, not a row a fact. A fact is current from its
    own seq on, up to the one before its end; rows without a subject have none.
    """
    key = ["project_id", "subject_key"]
    steps = valid.where("ended is null or ended > seq").select(*key, F.explode(F.array(F.struct(F.col("seq").cast("long").alias("at"), F.lit(1).alias("n")), F.struct(F.col("ended").alias("at"), F.lit(-1).alias("n")))).alias("s")).where("s.at is not null")
    steps = steps.groupBy(*key, F.col("s.at").alias("at")).agg(F.sum("s.n").alias("n"))
    blank = F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType)
    line = steps.select(*key, "at", "n", blank.alias("row")).union(asked.select(*key, F.col("seq").cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.struct("*").alias("row")))
    w = Window.partitionBy(*key).orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(F.col("subject_key"), F.lit("")) != ""
    return line.withColumn("n_current", F.when(known, F.sum("n").over(w)).otherwise(0)).where("row is not null").select("row.*", "n_current")


def open_contradictions(facts: DataFrame, met: DataFrame) -> DataFrame:
    """``project_id, subject_key, memory_id_a, memory_id_b, seq``: pairs found on arrival of which both facts are still current, smaller id first."""
    ended = validity(facts, met).where("ended is not null").select("memory_id")
    pairs = met.select("project_id", "subject_key", "seq", F.col("memory_id").alias("x"), F.explode("contradicts").alias("y"))
    pairs = pairs.select("project_id", "subject_key", F.least("x", "y").alias("memory_id_a"), F.greatest("x", "y").alias("memory_id_b"), "seq")
    for side in ("memory_id_a", "memory_id_b"):
        pairs = pairs.join(ended.withColumnRenamed("memory_id", side), side, "left_anti")
    return pairs.select("project_id", "subject_key", "memory_id_a", "memory_id_b", "seq")
