"""The trust ladder: where a record starts, whether it may climb, widen or be withdrawn, as column expressions.

A record is a row; its evidence is a column ``evidence``, an array of structs (event_id, event_type, source, command,
reviewer, commit_sha, recorded_at, linked) in seq order. A decision is a struct (allowed, rule). All rules are ``when`` chains, so
that a whole table is decided in one pass without a shuffle; ``with_evidence`` gathers the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.ranking import TERMINAL, trust_rank
from evidentia.functions.safety import POISON_THRESHOLD

# The ladder, states without a way back, landed states, trusted sources, evidence types.
LADDER = ("quarantined", "observed", "verified", "reviewed", "integrated")
PERMANENT = ("superseded", "rejected")
LANDED = ("integrated_run", "accepted_user")
TRUSTED_SOURCES = ("kernel", "adapter", "human")
VERIFICATIONS = ("verification.passed", "verification.failed", "command.succeeded", "command.failed")
PASSES = ("verification.passed", "command.succeeded")
FAILURES = ("verification.failed", "command.failed")
EVIDENCE_TYPES = (
    *VERIFICATIONS, "review.approved", "review.rejected", "review.changes_requested", "human.decision", "human.promotion", "human.invalidation",
    "human.rejection", "integration.landed", "integration.reverted", "branch.rejected",
)
#: The highest state without landed history, by type; decisions rest on a person.
CEILING = {"episodic": "verified", "semantic": "reviewed", "procedural": "verified", "decision": "integrated", "gotcha": "verified", "performance": "verified"}
NEVER_INTEGRATED = ("episodic", "performance")
BREADTH = {"agent": 1, "attempt": 2, "task": 3, "run": 4, "branch": 5, "repository": 6, "project": 7, "global": 8}


def one_space(command: Column) -> Column:
    """White space made equal and nothing else: a procedure is verified by its own command alone."""
    return F.trim(F.regexp_replace(command, r"(?U)\s+", " "))


def initial_state(source: Column, risk: Column, threshold: float = POISON_THRESHOLD) -> Column:
    """Where a record of an event starts: people and tools observe, everything else and hostile text is held back."""
    return F.when(risk >= threshold, "quarantined").when(source.isin(*TRUSTED_SOURCES), "observed").otherwise("quarantined")


def independent(author: Column, reviewer: Column) -> Column:
    """Whether a reviewer is someone else than the author; an unknown side counts as independent."""
    a, b = F.lower(F.trim(author)), F.lower(F.trim(reviewer))
    return F.coalesce((a == "") | (b == "") | (a != b), F.lit(True))


def commit_sha(value: Column) -> Column:
    """A commit id in lower case, null if blank or none."""
    v = F.lower(F.trim(value))
    return F.when(v.rlike("^[0-9a-f]{4,64}$"), v)


def landed(state: str = "integration_state") -> Column:
    return F.coalesce(F.col(state).isin(*LANDED), F.lit(False))


def presentable() -> Column:
    """Whether a record may be shown as current truth without a label."""
    current = ~F.col("trust_state").isin(*TERMINAL) & F.col("invalid_at").isNull()
    return current & ((F.col("memory_type") != "semantic") | ((F.col("trust_state") == "integrated") & landed()))


def _decision(rule: str, allowed: bool = False) -> Column:
    return F.struct(F.lit(allowed).alias("allowed"), F.lit(rule).alias("rule"))


def _some(test) -> Column:
    return F.exists("evidence", test)


def _rank(state: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(LADDER):
        out = F.when(state == name, i + 1).otherwise(out)
    return out


def can_promote(target: Column, actor: Column, threshold: float = POISON_THRESHOLD, state: Column | None = None, invalid_at: Column | None = None) -> Column:
    """Decision on ``memory_type, trust_state, integration_state, poisoning_risk, author_agent, command, invalid_at, evidence``.

    The most absolute refusals come first; a climb is one rung at a time. ``state`` and ``invalid_at`` stand in for the columns, if given.
    """
    kind, state = F.col("memory_type"), F.col("trust_state") if state is None else state
    ended = F.col("invalid_at") if invalid_at is None else invalid_at
    goal, at = _rank(target), _rank(state)
    verification = _some(lambda e: e["event_type"].isin(*VERIFICATIONS))
    trusted = _some(lambda e: e["event_type"].isin(*VERIFICATIONS) & e["source"].isin(*TRUSTED_SOURCES))
    human = _some(lambda e: (e["event_type"] == "human.decision") & (e["source"] == "human"))
    landing = _some(lambda e: (e["event_type"] == "integration.landed") & e["commit_sha"].isNotNull())
    same = F.exists("evidence", lambda e: e["event_type"].isin(*PASSES) & e["source"].isin(*TRUSTED_SOURCES) & (one_space(e["command"]) == one_space(F.col("command"))))
    failure = _some(lambda e: e["event_type"].isin(*FAILURES) & e["source"].isin(*TRUSTED_SOURCES))
    approval = _some(lambda e: e["event_type"] == "review.approved")
    other = _some(lambda e: (e["event_type"] == "review.approved") & independent(F.col("author_agent"), e["reviewer"]))
    fresh = _some(lambda e: e["event_type"].isin(*EVIDENCE_TYPES) & (ended.isNull() | (e["recorded_at"] > ended)))
    ceiling = F.lit(5)
    for name, top in CEILING.items():
        ceiling = F.when(kind == name, LADDER.index(top) + 1).otherwise(ceiling)

    observed = F.when(_some(lambda e: e["linked"]), _decision("promote.any.evidence_linked", True)).otherwise(_decision("refuse.no_qualifying_evidence"))
    verified = (
        F.when((kind == "decision") & human, _decision("promote.decision.human_authority", True))
        .when((kind == "semantic") & ((landed() & landing) | human), _decision("promote.semantic.landed_or_human_authority", True))
        .when(~verification, _decision("refuse.no_qualifying_evidence"))
        .when(~trusted, _decision("refuse.source_ceiling"))
        .when(kind == "procedural", F.when(F.coalesce((one_space(F.col("command")) != "") & same, F.lit(False)), _decision("promote.procedural.verified_by_exact_command", True)).otherwise(_decision("refuse.no_qualifying_evidence")))
        .when(kind == "gotcha", F.when(failure, _decision("promote.gotcha.verified_by_failure_evidence", True)).otherwise(_decision("refuse.no_qualifying_evidence")))
        .otherwise(_decision("promote.any.verified_by_evidence", True))
    )
    reviewed = (
        F.when((kind == "decision") & human, _decision("promote.decision.human_authority", True))
        .when(~approval, _decision("refuse.no_qualifying_evidence"))
        .when(~other, _decision("refuse.self_review"))
        .otherwise(_decision("promote.any.independent_review_approved", True))
    )
    integrated = (
        F.when((kind == "decision") & human, _decision("promote.decision.human_authority", True))
        .when(landing & landed(), _decision("promote.any.landed_in_history", True))
        .otherwise(_decision("refuse.not_landed"))
    )
    again = (
        F.when(actor == "agent", _decision("refuse.agent_cannot_promote"))
        .when(~fresh, _decision("refuse.no_qualifying_evidence"))
        .when(goal > 3, _decision("refuse.rung_skipped"))
        .otherwise(_decision("revalidate.invalidated.fresh_evidence", True))
    )
    return (
        F.when(state == "rejected", _decision("refuse.rejected_never_promoted"))
        .when(state == "superseded", _decision("refuse.permanent_state"))
        .when((state == "invalidated") & (target != "invalidated"), again)
        .when(actor == "agent", _decision("refuse.agent_cannot_promote"))
        .when(target.isin(*TERMINAL) | (goal <= at), _decision("refuse.not_a_promotion"))
        .when(goal != at + 1, _decision("refuse.rung_skipped"))
        .when(F.col("poisoning_risk") >= threshold, _decision("refuse.poisoning_risk"))
        .when((target == "integrated") & kind.isin(*NEVER_INTEGRATED), _decision("refuse.type_never_integrated"))
        .when((goal > ceiling) & ~landed(), _decision("refuse.type_ceiling"))
        .when(target == "observed", observed)
        .when(target == "verified", verified)
        .when(target == "reviewed", reviewed)
        .otherwise(integrated)
    )


def next_rung(state: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in zip(LADDER, LADDER[1:]):
        out = F.when(state == low, high).otherwise(out)
    return out


def evidence_states(evidence: Column) -> tuple[Column, Column]:
    """Review and integration state of an evidence array; a rejection outranks an approval, a revert a landing."""
    def has(kind: str) -> Column:
        return F.exists(evidence, lambda e: e["event_type"] == kind)

    review = F.when(has("review.rejected"), "rejected").when(has("review.changes_requested"), "changes_requested").when(has("review.approved"), "approved").otherwise("none")
    last = F.element_at(F.filter(evidence, lambda e: e["event_type"] == "integration.landed"), -1)
    state = F.when(has("integration.reverted"), "reverted").when(has("integration.landed"), F.when(last["target"] == "user", "accepted_user").otherwise("integrated_run")).otherwise("none")
    return review, state


def can_withdraw(action: str, rule: str, state: Column | None = None) -> Column:
    """Decision on invalidate or reject, by ``trust_state``."""
    state = F.col("trust_state") if state is None else state
    refused = state == "rejected" if action == "reject" else state.isin(*PERMANENT, "invalidated")
    return F.when(refused, _decision("refuse.already_terminal")).otherwise(_decision(rule, True))


def can_supersede(old: str, new: str) -> Column:
    """Decision on two aliased rows."""
    a, b = (lambda c, side=side: F.col(f"{side}.{c}") for side in (old, new))
    return (
        F.when(a("memory_id") == b("memory_id"), _decision("refuse.self_supersession"))
        .when(a("trust_state").isin(*PERMANENT), _decision("refuse.already_terminal"))
        .when(a("memory_type") != b("memory_type"), _decision("refuse.supersession_type_mismatch"))
        .when(a("project_id") != b("project_id"), _decision("refuse.supersession_scope_mismatch"))
        .otherwise(_decision("supersede.replaced_by_newer_record", True))
    )


def can_widen(target: str, actor: Column) -> Column:
    """Decision on a wider scope, by ``scope_level`` and ``integration_state``."""
    level = F.lit(0)
    for name, i in BREADTH.items():
        level = F.when(F.col("scope_level") == name, i).otherwise(level)
    if target == "global":
        return _decision("refuse.scope_global_unreachable")
    out = F.when(level >= BREADTH[target], _decision("refuse.scope_narrowing")).when(actor == "agent", _decision("refuse.scope_agent_cannot_widen"))
    if target == "repository":
        return out.when(~landed(), _decision("refuse.scope_widen_not_landed")).otherwise(_decision("scope.branch_to_repository.landed", True))
    if target == "project":
        return out.when(actor != "human", _decision("refuse.scope_widen_needs_human")).otherwise(_decision("scope.repository_to_project.human_approved", True))
    return out.otherwise(_decision("refuse.scope_narrowing"))


#: Fields of an evidence entry, besides event_id.
EVIDENCE = ("event_type", "source", "command", "reviewer", "commit_sha", "recorded_at", "linked", "target")


def with_evidence(records: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``evidence`` to records (``memory_id, source_event_ids``): their events in seq order. An event that many records cite is read once for each."""
    cited = records.select("memory_id", F.explode("source_event_ids").alias("event_id")).distinct()
    entry = F.struct("seq", "event_id", *EVIDENCE)
    found = cited.join(events, "event_id").groupBy("memory_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"))
    empty = F.array().cast(found.schema["evidence"].dataType)
    return records.join(found, "memory_id", "left").withColumn("evidence", F.coalesce("evidence", empty))
