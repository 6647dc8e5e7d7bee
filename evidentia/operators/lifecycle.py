"""Requests upon records in the order of the journal: promote, reject, invalidate, supersede, and what comes of each.

What a request may do depends on the record's evidence, which doesn't change with its state, and on its state at that moment. So each
request gets a table of decisions first, one for every state it may meet (column expressions, one pass), and the ordered fold that
follows only looks up: state and table give the next state. Requests of a record stream in order past one small state, so that a record with
very many requests costs no memory; nothing is collected by record.

Every request leaves a row: a transition if it was allowed, a refusal with its rule if not. Only people and the kernel may withdraw a
record (reject, invalidate, supersede), and only in its own project. Rejected and superseded records never come back; an invalidated one may be
promoted again, to verified at most, on evidence that is newer than its invalidation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.safety import POISON_THRESHOLD
from evidentia.operators import trust

#: States by number; the last one stands for an invalidated record whose evidence is newer than its invalidation.
STATES = (*trust.LADDER, "invalidated", "superseded", "rejected", "invalidated, fresh")
INVALIDATED, FRESH = STATES.index("invalidated"), len(STATES) - 1
# Who may withdraw a record, what a withdrawal makes of it, and its rule.
WITHDRAWAL_SOURCES = ("human", "kernel")
WITHDRAWALS = {"reject": ("rejected", "reject.human_or_kernel"), "invalidate": ("invalidated", "invalidate.human_or_kernel"), "supersede": ("superseded", "supersede.replaced_by_newer_record")}
REFUSE_SOURCE, REFUSE_PROJECT, REFUSE_ACTION = "refuse.withdrawal_source", "refuse.withdrawal_foreign_project", "refuse.unknown_action"
_DECISION = "struct<allowed: boolean, rule: string>"


def _withdrawal(action: str, state: Column) -> Column:
    """The decision on a withdrawal, by ``source`` and both projects."""
    rule = WITHDRAWALS[action][1]
    allowed = trust.can_withdraw(action, rule, state)
    if action == "supersede":
        allowed = F.when(state.isin(*trust.PERMANENT), trust._decision("refuse.already_terminal")).otherwise(trust._decision(rule, True))
    gate = F.when(~F.col("source").isin(*WITHDRAWAL_SOURCES), trust._decision(REFUSE_SOURCE)).when(~F.col("by_project").eqNullSafe(F.col("project_id")), trust._decision(REFUSE_PROJECT))
    return gate.otherwise(allowed)


def decided(requests: DataFrame, threshold: float = POISON_THRESHOLD) -> DataFrame:
    """Adds ``decisions``: what each state would make of the request; and ``newest``, the time of the newest evidence."""
    action = F.col("action")
    # A stale invalidation lies after all evidence, a fresh one before.
    never = F.lit(None).cast("timestamp_ntz")
    met = [F.struct(F.lit("invalidated" if i == FRESH else s).alias("state"), (F.lit("9999-12-31").cast("timestamp_ntz") if i == INVALIDATED else never).alias("ended")) for i, s in enumerate(STATES)]

    def decision(x: Column) -> Column:
        out = F.when(action == "promote", trust.can_promote(F.col("target"), F.col("source"), threshold, x["state"], x["ended"]))
        for kind in WITHDRAWALS:
            out = out.when(action == kind, _withdrawal(kind, x["state"]))
        return out.otherwise(trust._decision(REFUSE_ACTION)).cast(_DECISION)

    evidence = F.filter("evidence", lambda e: e["event_type"].isin(*trust.EVIDENCE_TYPES))
    newest = F.array_max(F.transform(evidence, lambda e: F.unix_micros(e["recorded_at"].cast("timestamp"))))
    return requests.withColumns({"newest": newest, "decisions": F.transform(F.array(*met), decision)})


def _number(name: Column) -> Column:
    """Null for no state."""
    return reduce(lambda out, i: F.when(name == STATES[i], i).otherwise(out), range(len(STATES) - 1), F.lit(None).cast("int"))


def history(records: DataFrame, requests: DataFrame, threshold: float = POISON_THRESHOLD) -> DataFrame:
    """``memory_id, seq, action, from_state, to_state, allowed, rule, source, recorded_at``: what became of every request.

    records: ``memory_id, project_id, memory_type, trust_state, integration_state, poisoning_risk, author_agent, command, invalid_at, evidence``;
    requests: ``memory_id, seq, action, target, source, project_id, recorded_at``. A request upon no record leaves no row; one without a
    known action is refused; a refused promotion keeps the asked state as ``to_state``; a record without a known state counts as quarantined. Requests with equal seq go by action and target.
    """
    said = requests.select("memory_id", "seq", "action", "target", "source", F.col("project_id").alias("by_project"), "recorded_at")
    asked = said.join(records.select("memory_id", "project_id", "memory_type", "trust_state", "integration_state", "poisoning_risk", "author_agent", "command", "invalid_at", "evidence"), "memory_id")
    asked = asked.withColumns({"start": F.coalesce(_number(F.col("trust_state")), F.lit(0)), "ended": F.unix_micros(F.col("invalid_at").cast("timestamp")), "at": F.unix_micros(F.col("recorded_at").cast("timestamp"))})
    to = reduce(lambda out, kind: F.when(F.col("action") == kind, WITHDRAWALS[kind][0]).otherwise(out), WITHDRAWALS, F.col("target"))
    rows = decided(asked, threshold).withColumn("to_state", to).withColumn("goal", _number(F.col("to_state")))
    mask = F.aggregate(F.reverse("decisions"), F.lit(0), lambda sum_, d: sum_ * 2 + d["allowed"].cast("int"))
    kept = ["memory_id", "seq", "action", "target", "to_state", "source", "recorded_at", "decisions", "start", "ended", "at", "newest", "goal"]
    rows = rows.select(*kept, mask.cast("int").alias("mask")).repartition("memory_id").sortWithinPartitions("memory_id", "seq", "action", "target")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, ended = object(), 0, None
        for batch in batches:
            found = []
            for memory_id, start, end, at, newest, goal, mask in zip(*(batch.column(c).to_pylist() for c in ("memory_id", "start", "ended", "at", "newest", "goal", "mask")), strict=True):
                if memory_id != key:
                    key, state, ended = memory_id, start, end
                now = FRESH if state == INVALIDATED and newest is not None and (ended is None or newest > ended) else state
                found.append(now)
                if mask >> now & 1:
                    state = goal
                    if goal >= INVALIDATED:
                        ended = at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "met"])

    out = rows.mapInArrow(fold, rows.select("*", F.lit(0).cast("int").alias("met")).schema)
    met = F.col("decisions")[F.col("met")]
    names = F.array(*(F.lit("invalidated" if i == FRESH else s) for i, s in enumerate(STATES)))
    return out.select("memory_id", "seq", "action", names[F.col("met")].alias("from_state"), "to_state", met["allowed"].alias("allowed"), met["rule"].alias("rule"), "source", "recorded_at")


def transitions(told: DataFrame) -> DataFrame:
    """The changes of state of a ``history``."""
    return told.where("allowed").drop("allowed")


def refusals(told: DataFrame) -> DataFrame:
    """The refused requests of a ``history``: what was asked, by whom, and the rule that forbade it."""
    return told.where("not allowed").drop("allowed")


def applied(records: DataFrame, told: DataFrame) -> DataFrame:
    """Records with the state that their last transition left; a withdrawal sets ``invalid_at``."""
    last = F.max(F.struct("seq", "to_state"))["to_state"]
    ended = F.max(F.when(F.col("to_state").isin("invalidated", "superseded", "rejected"), F.struct("seq", "recorded_at")))["recorded_at"]
    done = transitions(told).groupBy("memory_id").agg(last.alias("_state"), ended.alias("_ended"))
    rows = records.join(done, "memory_id", "left")
    return rows.withColumns({"trust_state": F.coalesce("_state", "trust_state"), "invalid_at": F.coalesce("_ended", "invalid_at")}).select(records.columns)
