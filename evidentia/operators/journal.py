"""Operators over the event journal: filters, folds, resolutions and chains."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import normalize_command

@dataclass(frozen=True)
class EventFilter:
    """A conjunctive filter; it compiles to one predicate, so that it reaches the scan."""

    project_id: str | None = None
    event_types: Sequence[str] = ()
    task_id: str | None = None
    agent_profile: str | None = None
    sources: Sequence[str] = ()
    run_id: str | None = None
    attempt_id: str | None = None
    branch: str | None = None
    commit_sha: str | None = None
    since: str | None = None
    until: str | None = None
    limit: int | None = None
    offset: int = 0
    descending: bool = False

    def predicate(self) -> Column:
        names = ("project_id", "task_id", "agent_profile", "run_id", "attempt_id", "branch", "commit_sha")
        parts = [F.col(c) == getattr(self, c) for c in names if getattr(self, c) is not None]
        if self.sources:
            parts.append(F.col("source").isin(*self.sources))
        if self.event_types:
            parts.append(F.col("event_type").isin(*self.event_types))
        if self.since is not None:
            parts.append(F.col("recorded_at") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until is not None:
            parts.append(F.col("recorded_at") <= F.lit(self.until).cast("timestamp_ntz"))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, journal: DataFrame) -> DataFrame:
        rows = journal.where(self.predicate())
        if self.limit is None and not self.offset:
            return rows
        rows = rows.orderBy(F.desc("seq") if self.descending else F.asc("seq"))
        rows = rows.offset(self.offset) if self.offset else rows
        return rows if self.limit is None else rows.limit(self.limit)


def project_heads(journal: DataFrame) -> DataFrame:
    """Of each project: event count, first and last seq, first record time."""
    return journal.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("recorded_at").alias("created_at"))


def scan(journal: DataFrame, project_id: str | None = None, after: int | None = None, batch: int | None = None) -> DataFrame:
    """Events in seq order; with ``after`` and ``batch`` a page by key, which costs no more the further it lies."""
    rows = journal if project_id is None else journal.where(F.col("project_id") == project_id)
    rows = rows if after is None else rows.where(F.col("seq") > after)
    rows = rows.orderBy("seq")
    return rows if batch is None else rows.limit(batch)


def lookup(journal: DataFrame, ids: DataFrame) -> DataFrame:
    """The events of the given ``event_id`` rows; ids without an event are silently absent."""
    return journal.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def failure_fold(journal: DataFrame) -> DataFrame:
    """One row a (project, signature) of failed verifications; what describes it comes from its first event."""
    failed = journal.where(F.col("event_type") == "verification.failed")
    first = F.min_by(F.struct("event_id", "command", "error_kind", "task_id", "run_id", "purpose", "branch"), "seq")
    folded = failed.groupBy("project_id", "signature").agg(first.alias("f"), F.count(F.lit(1)).alias("occurrences"), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"), F.min("seq").alias("first_seq"))
    return folded.select("project_id", "signature", F.col("f.event_id").alias("first_event_id"), F.col("f.command").alias("command"), F.col("f.error_kind").alias("error_kind"), F.col("f.task_id").alias("task_id"), F.col("f.run_id").alias("run_id"), F.col("f.purpose").alias("purpose"), F.col("f.branch").alias("branch"), "occurrences", "first_seen", "last_seen", "first_seq")


def occurrences(journal: DataFrame) -> DataFrame:
    """Each failure with its number within its signature, by seq."""
    w = Window.partitionBy("project_id", "signature").orderBy("seq")
    return journal.where(F.col("event_type") == "verification.failed").select("seq", "project_id", "signature", F.row_number().over(w).alias("occurrence"))


def resolutions(journal: DataFrame) -> DataFrame:
    """Of each failure signature: the first later success that is linked to it.

    A success that names a signature resolves that one alone; a landing may name one too. Another resolves the failures of its task (or run, without one)
    that failed with its command or declared its purpose. Failures and successes of a key stand in one sequence, whose running
    minimum from the end is the next success, so that a key costs a row an event.
    """
    failures = failure_fold(journal)
    scope = F.coalesce("task_id", "run_id")
    passed = journal.where(F.col("event_type") == "verification.passed")
    declared = journal.where(F.col("event_type").isin("verification.passed", "integration.landed")).where(F.coalesce(F.trim("resolves_signature"), F.lit("")) != "")
    open_ = passed.where(F.coalesce(F.trim("resolves_signature"), F.lit("")) == "").where(scope.isNotNull() & (F.coalesce(F.trim("command"), F.lit("")) != ""))

    def keyed(rows: DataFrame, kind: str, key: Column, success: bool) -> DataFrame:
        at = F.struct(F.col("seq").alias("s"), F.col("recorded_at").alias("t")) if success else F.lit(None).cast("struct<s: bigint, t: timestamp_ntz>")
        return rows.select("project_id", F.lit(kind).alias("kind"), key.alias("key"), F.lit(None).cast("string").alias("signature") if success else F.col("signature"), (F.col("seq") if success else F.col("first_seq")).alias("seq"), at.alias("success"))

    purpose = F.lower(F.trim("purpose"))
    ways = (("command", F.struct(scope, normalize_command("command")), open_), ("purpose", F.struct(scope, F.when(purpose != "", purpose)), open_))
    rows = [keyed(side, kind, F.to_json(key), success).where(key.getField("col2").isNotNull()) for kind, key, successes in ways for side, success in ((failures.where(scope.isNotNull()), False), (successes, True))]
    rows += [keyed(failures, "declared", F.col("signature"), False), keyed(declared, "declared", F.trim("resolves_signature"), True)]
    later = Window.partitionBy("project_id", "kind", "key").orderBy(F.desc("seq"), F.col("success").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    met = reduce(DataFrame.union, rows).withColumn("next", F.min("success").over(later)).where(F.col("signature").isNotNull() & F.col("next").isNotNull())
    return met.groupBy("project_id", "signature").agg(F.min("next").alias("r")).select("project_id", "signature", F.col("r.s").alias("resolved_by_event"), F.col("r.t").alias("resolved_at"))


def repeat_failures(journal: DataFrame) -> DataFrame:
    """Repeated failures with the fix that followed."""
    folded = failure_fold(journal).where("occurrences >= 2")
    out = folded.join(resolutions(journal), ["project_id", "signature"], "left")
    minutes = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / F.lit(60_000_000)
    return out.select("project_id", "signature", "command", "occurrences", "first_seen", "last_seen", "resolved_by_event", F.floor(minutes).cast("long").alias("minutes_to_fix"))


def performance(journal: DataFrame) -> DataFrame:
    """Per project and agent: attempts, successes, verifications, approvals and the success rate."""

    def count(p: Column) -> Column:
        return F.sum(p.cast("long"))

    kind = F.col("event_type")
    rows = journal.where(kind.isin("attempt.completed", "verification.passed", "verification.failed", "review.approved"))
    out = rows.groupBy("project_id", "agent_profile", "adapter").agg(
        count(kind == "attempt.completed").alias("attempts"),
        count((kind == "attempt.completed") & F.col("ok")).alias("successes"),
        count(kind.startswith("verification.")).alias("verifications"),
        count(kind == "review.approved").alias("approvals"),
        F.min("recorded_at").alias("first_seen"),
        F.max("recorded_at").alias("last_seen"),
        F.sha2(F.array_join(F.array_sort(F.collect_set("event_id")), ","), 256).alias("event_ids_sha256"),
    )
    return out.withColumn("success_rate", F.when(F.col("attempts") > 0, F.bround(F.col("successes") / F.col("attempts"), 4)))


def contradictions(journal: DataFrame) -> DataFrame:
    """Facts on one subject of a project and branch whose statements differ: one row for each, with the first statement of the subject.

    All statements of a subject contradict each other, so that the class and its first member say it all: pairs are not written out.
    """
    facts = journal.where(F.col("event_type") == "fact.observed").groupBy("project_id", "branch", "subject_key", "statement").agg(F.min("seq").alias("seq"))
    first = facts.groupBy("project_id", "branch", "subject_key").agg(F.min(F.struct("seq", "statement")).alias("first"), F.count(F.lit(1)).alias("statements")).where("statements > 1")
    a, b = facts.alias("a"), first.alias("b")
    same = (F.col("a.project_id") == F.col("b.project_id")) & F.col("a.branch").eqNullSafe(F.col("b.branch")) & (F.col("a.subject_key") == F.col("b.subject_key"))
    return a.join(b, same).select("a.project_id", "a.branch", "a.subject_key", "a.statement", "a.seq", F.col("first.seq").alias("first_seq"), "statements")


def latest_facts(journal: DataFrame) -> DataFrame:
    """The latest fact of each subject."""
    facts = journal.where(F.col("event_type") == "fact.observed")
    return facts.groupBy("project_id", "subject_key").agg(F.max_by("statement", "seq").alias("statement"), F.max("seq").alias("seq"))


def last_reviews(journal: DataFrame) -> DataFrame:
    """Of each task: how many approvals, and the last one's reviewer."""
    return journal.where(F.col("event_type") == "review.approved").groupBy("project_id", "task_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.max_by("agent_profile", "seq").alias("last_reviewer"))


def duplicate_payloads(journal: DataFrame) -> DataFrame:
    return journal.groupBy("project_id", "event_type", "subject_key", "statement").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: What an event says, without its number and time.
CONTENT = ("event_type", "source", "task_id", "run_id", "branch", "command", "error_kind", "purpose", "subject_key", "statement")


def repeated_payloads(journal: DataFrame, content: tuple[str, ...] = CONTENT) -> DataFrame:
    """Events of a project that say the same: ``project_id, payload_hash, n, first_seq, last_seq``. A missing field is told from an empty one.

    Only hashes and sequence numbers are shuffled, summed up by each task before that.
    """
    fields = F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in content))
    rows = journal.select("project_id", "seq", F.sha2(fields, 256).alias("payload_hash"))
    return rows.groupBy("project_id", "payload_hash").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).where("n > 1")


#: Sequence numbers of a project that one segment of its chain spans.
SEGMENT = 65_536


def chained(journal: DataFrame, segment: int = SEGMENT, payload: Column | None = None) -> DataFrame:
    """Adds ``segment, payload_hash, prev_hash, event_hash``: hash chains in seq order, one a (project, segment of seq).

    Segments are chained side by side and their rows stream in order, so that a task holds one hash, whatever a
    project's size; ``segment_heads`` chains the segments of a project.
    """
    import hashlib

    payload = F.sha2(F.concat_ws("|", "event_id", "event_type", "task_id", "command", "statement"), 256) if payload is None else payload
    columns = ["project_id", "seq", "segment", "payload_hash"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head = None, ""
        for batch in batches:
            hashes, heads = [], []
            for *at, p in zip(*(batch.column(c).to_pylist() for c in ("project_id", "segment", "payload_hash")), strict=True):
                if at != place:
                    place, head = at, ""
                heads.append(head)
                head = hashlib.sha256(f"{head}|{p}".encode()).hexdigest()
                hashes.append(head)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(heads, pa.string()), pa.array(hashes, pa.string())], [*columns, "prev_hash", "event_hash"])

    rows = journal.select("project_id", "seq", F.expr(f"seq div {segment}").alias("segment"), payload.alias("payload_hash"))
    rows = rows.repartition("project_id", "segment").sortWithinPartitions("project_id", "segment", "seq", "payload_hash")
    return rows.mapInArrow(link, "project_id string, seq long, segment long, payload_hash string, prev_hash string, event_hash string")


def _checked(chain: DataFrame) -> DataFrame:
    """Adds ``broken``: whether a row's stored hashes don't follow; by stored neighbours, parallel by segment."""
    w = Window.partitionBy("project_id", "segment").orderBy("seq", "payload_hash")
    before = F.coalesce(F.lag("event_hash").over(w), F.lit(""))
    expected = F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), F.col("payload_hash")), 256)
    return chain.withColumn("broken", ~F.coalesce((F.col("prev_hash") == before) & (F.col("event_hash") == expected), F.lit(False)))


def broken_links(chain: DataFrame) -> DataFrame:
    """Rows whose stored hashes don't follow."""
    return _checked(chain).where("broken").drop("broken")


def _segments(chain: DataFrame) -> DataFrame:
    """Of each segment: rows, broken rows and its last hash."""
    last = F.max(F.struct("seq", "payload_hash", "event_hash"))["event_hash"]
    return _checked(chain).groupBy("project_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("broken").cast("long")).alias("broken"), last.alias("last_hash"))


def _head_hash() -> Column:
    return F.sha2(F.concat_ws("|", "prev_head", F.col("segment").cast("string"), F.col("n").cast("string"), "last_hash"), 256)


def segment_heads(chain: DataFrame) -> DataFrame:
    """``project_id, segment, n, last_hash, prev_head, head``: the chain of a project's segments, in order.

    One short row a segment: ``SEGMENT`` times fewer than events, so this is the sequential part.
    """
    import hashlib

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment")
        head, before, heads = "", [], []
        for segment, n, last in zip(rows["segment"], rows["n"], rows["last_hash"], strict=True):
            before.append(head)
            head = hashlib.sha256(f"{head}|{segment}|{n}|{last}".encode()).hexdigest()
            heads.append(head)
        return rows.assign(prev_head=before, head=heads)

    segments = _segments(chain).select("project_id", "segment", "n", "last_hash")
    return segments.groupBy("project_id").applyInPandas(link, "project_id string, segment long, n long, last_hash string, prev_head string, head string")


def audit(chain: DataFrame, heads: DataFrame) -> DataFrame:
    """``project_id, n, broken``: rows of the chain, and how many rows and segment heads don't follow or are missing."""
    w = Window.partitionBy("project_id").orderBy("segment")  # one row a segment
    before = F.coalesce(F.lag("head").over(w), F.lit(""))
    stored = heads.withColumn("follows", F.coalesce((F.col("prev_head") == before) & (F.col("head") == _head_hash()), F.lit(False)))
    found, stored = _segments(chain).alias("f"), stored.alias("s")
    both = found.join(stored, F.col("f.project_id").eqNullSafe(F.col("s.project_id")) & F.col("f.segment").eqNullSafe(F.col("s.segment")), "full")
    same = F.coalesce(F.col("s.follows") & (F.col("f.n") == F.col("s.n")) & (F.col("f.last_hash") == F.col("s.last_hash")), F.lit(False))
    bad = F.coalesce("f.broken", F.lit(0)) + F.when(same, 0).otherwise(1)
    return both.groupBy(F.coalesce("f.project_id", "s.project_id").alias("project_id")).agg(F.sum(F.coalesce("f.n", F.lit(0))).cast("long").alias("n"), F.sum(bad).cast("long").alias("broken"))


def append(journal: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and conflicts (an event_id with two payloads, in the batch or against the journal). Known equal rows are dropped.

    A missing hash is a payload of its own: equal to another missing one alone.
    """
    known = journal.select("event_id", F.col("payload_hash").alias("known_hash"), F.lit(True).alias("known"))
    each = new.dropDuplicates(["event_id", "payload_hash"])
    twice = each.groupBy("event_id").agg((F.count(F.lit(1)) > 1).alias("twice"))
    joined = each.join(known, "event_id", "left").join(twice, "event_id")
    conflict = F.col("twice") | (F.col("known").isNotNull() & ~F.col("known_hash").eqNullSafe(F.col("payload_hash")))
    return joined.where(~conflict & F.col("known").isNull()).select(new.columns), joined.where(conflict).select(new.columns)


def append_all(journal: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of a batch to append, all or none: a conflict refuses the whole batch."""
    fresh, conflicts = append(journal, new)
    bad = conflicts.select("event_id").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"event ids with another payload: {sorted(r[0] for r in bad)}")
    return fresh


def nearest_rank(values: DataFrame, column: str, by: str) -> DataFrame:
    """Median (mean of the middle two) and nearest-rank 95th percentile by group."""
    # Equal values are counted before they meet; ranks come from running counts.
    counts = values.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy(column))).withColumn("n", F.sum("c").over(w))

    def at(rank: Column) -> Column:
        """The value of a rank from 0: the smallest whose running count passes it."""
        return F.min(F.when(F.col("upto") > rank, F.col(column)))

    half = F.floor((F.col("n") - 1) / 2)
    return ranked.groupBy(by).agg(((at(half) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), at(F.bround(0.95 * (F.col("n") - 1))).alias("p95"), F.max(column).alias("max"))
