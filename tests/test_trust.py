"""The trust ladder: each rung's evidence, the order of refusals, withdrawal and scope."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import trust

EVIDENCE = "array<struct<seq: bigint, event_id: bigint, event_type: string, source: string, command: string, reviewer: string, commit_sha: string, recorded_at: string, linked: boolean, target: string>>"
SCHEMA = f"memory_type string, trust_state string, integration_state string, poisoning_risk double, author_agent string, command string, invalid_at string, target string, actor string, evidence {EVIDENCE}"


def event(kind, source="kernel", command=None, reviewer=None, commit=None, at="2024-01-02", linked=True, target=None, seq=1):
    return (seq, seq, kind, source, command, reviewer, commit, at, linked, target)


PASS, FAIL = event("verification.passed", command="pytest  -q"), event("verification.failed", command="x")
HUMAN, LANDED = event("human.decision", "human"), event("integration.landed", commit="abc123")
APPROVED = event("review.approved", reviewer="Other")


def case(kind="gotcha", state="observed", target="verified", evidence=(), integration="none", risk=0.0, author="me", command="pytest -q", invalid=None, actor="kernel"):
    return (kind, state, integration, risk, author, command, invalid, target, actor, list(evidence))


CASES = [
    (case(state="rejected", actor="agent"), "refuse.rejected_never_promoted"),
    (case(state="superseded"), "refuse.permanent_state"),
    (case(state="invalidated", invalid="2024-01-01", evidence=[PASS]), "revalidate.invalidated.fresh_evidence"),
    (case(state="invalidated", invalid="2024-01-03", evidence=[PASS]), "refuse.no_qualifying_evidence"),
    (case(state="invalidated", invalid="2024-01-01", evidence=[PASS], target="reviewed"), "refuse.rung_skipped"),
    (case(state="invalidated", actor="agent", evidence=[PASS]), "refuse.agent_cannot_promote"),
    (case(actor="agent", evidence=[FAIL]), "refuse.agent_cannot_promote"),
    (case(target="observed"), "refuse.not_a_promotion"),
    (case(target="rejected"), "refuse.not_a_promotion"),
    (case(target="reviewed", risk=0.9), "refuse.rung_skipped"),
    (case(evidence=[FAIL], risk=0.5), "refuse.poisoning_risk"),
    (case("episodic", "reviewed", "integrated", [LANDED], "accepted_user"), "refuse.type_never_integrated"),
    (case("procedural", "verified", "reviewed", [APPROVED]), "refuse.type_ceiling"),
    (case("procedural", "verified", "reviewed", [APPROVED], "integrated_run"), "promote.any.independent_review_approved"),
    (case(state="quarantined", target="observed", evidence=[FAIL]), "promote.any.evidence_linked"),
    (case(state="quarantined", target="observed", evidence=[event("verification.failed", linked=False)]), "refuse.no_qualifying_evidence"),
    (case(evidence=[FAIL]), "promote.gotcha.verified_by_failure_evidence"),
    (case(evidence=[PASS]), "refuse.no_qualifying_evidence"),
    (case(evidence=[event("verification.failed", "agent")]), "refuse.source_ceiling"),
    (case("procedural", evidence=[PASS]), "promote.procedural.verified_by_exact_command"),
    (case("procedural", evidence=[PASS], command="pytest"), "refuse.no_qualifying_evidence"),
    (case("procedural", evidence=[event("verification.failed", command="pytest -q")]), "refuse.no_qualifying_evidence"),
    (case("procedural", evidence=[PASS], command=None), "refuse.no_qualifying_evidence"),
    (case("episodic", evidence=[PASS]), "promote.any.verified_by_evidence"),
    (case("semantic", evidence=[HUMAN]), "promote.semantic.landed_or_human_authority"),
    (case("semantic", evidence=[LANDED]), "refuse.no_qualifying_evidence"),
    (case("semantic", evidence=[LANDED], integration="integrated_run"), "promote.semantic.landed_or_human_authority"),
    (case("semantic", "verified", "reviewed", [event("review.approved", reviewer=" ME ")]), "refuse.self_review"),
    (case("semantic", "verified", "reviewed", [APPROVED]), "promote.any.independent_review_approved"),
    (case("semantic", "reviewed", "integrated", [LANDED]), "refuse.type_ceiling"),
    (case("semantic", "reviewed", "integrated", [LANDED], "accepted_user"), "promote.any.landed_in_history"),
    (case("semantic", "reviewed", "integrated", [event("integration.landed")], "accepted_user"), "refuse.not_landed"),
    (case("decision", evidence=[HUMAN]), "promote.decision.human_authority"),
    (case("decision", "verified", "reviewed", [HUMAN]), "promote.decision.human_authority"),
    (case("decision", "reviewed", "integrated", [HUMAN]), "promote.decision.human_authority"),
    (case("decision", "reviewed", "integrated", [event("human.decision", "agent")]), "refuse.not_landed"),
]


def test_can_promote(spark):
    rows = spark.createDataFrame([(*row, i) for i, (row, _) in enumerate(CASES)], SCHEMA + ", i int")
    got = {r.i: r.d for r in rows.select("i", trust.can_promote(F.col("target"), F.col("actor")).alias("d")).collect()}
    for i, (row, rule) in enumerate(CASES):
        assert got[i].rule == rule, row
        assert got[i].allowed == rule.startswith(("promote.", "revalidate."))


def test_full_ladder_of_a_fact(spark):
    """From observed to integrated in three rungs, each by its own evidence."""
    state, steps = "observed", []
    for evidence in ([HUMAN], [HUMAN, APPROVED], [HUMAN, APPROVED, LANDED]):
        row = spark.createDataFrame([case("semantic", state, "", evidence, "accepted_user")], SCHEMA).withColumn("target", trust.next_rung(F.col("trust_state")))
        got = row.select("target", trust.can_promote(F.col("target"), F.lit("kernel")).alias("d")).first()
        assert got.d.allowed
        state = got.target
        steps.append(state)
    assert steps == ["verified", "reviewed", "integrated"]


@pytest.mark.parametrize("source, risk, state", [("human", 0.0, "observed"), ("kernel", 0.49, "observed"), ("adapter", 0.5, "quarantined"), ("agent", 0.0, "quarantined"), ("import", 0.0, "quarantined")])
def test_initial_state(spark, source, risk, state):
    assert spark.range(1).select(trust.initial_state(F.lit(source), F.lit(risk)).alias("x")).first().x == state


def test_evidence_states(spark):
    rows = [
        ([event("review.approved"), event("review.changes_requested")], "changes_requested", "none"), ([event("review.approved"), event("review.rejected")], "rejected", "none"),
        ([event("review.changes_requested"), event("review.approved")], "changes_requested", "none"), ([event("integration.landed", target="user", seq=2)], "none", "accepted_user"),
        ([event("integration.landed", target="user"), event("integration.landed", target="run", seq=2)], "none", "integrated_run"), ([event("integration.landed"), event("integration.reverted")], "none", "reverted"), ([], "none", "none"),
    ]
    frame = spark.createDataFrame([(i, e) for i, (e, _, _) in enumerate(rows)], f"i int, evidence {EVIDENCE}")
    review, integration = trust.evidence_states(F.col("evidence"))
    for r in frame.select("i", review.alias("a"), integration.alias("b")).collect():
        assert (r.a, r.b) == rows[r.i][1:]


def test_commit_ids_and_widening(spark):
    rows = spark.createDataFrame([(" ABCDEF1 ",), ("xyz",), ("abc",), (None,), ("",)], "v string").select(trust.commit_sha(F.col("v")).alias("x")).collect()
    assert [r.x for r in rows] == ["abcdef1", None, None, None, None]
    scopes = spark.createDataFrame([("branch", "none"), ("branch", "accepted_user"), ("project", "none")], "scope_level string, integration_state string")
    rules = scopes.select(trust.can_widen("repository", F.lit("kernel"))["rule"].alias("a"), trust.can_widen("project", F.lit("kernel"))["rule"].alias("b"), trust.can_widen("project", F.lit("agent"))["rule"].alias("c"), trust.can_widen("global", F.lit("human"))["rule"].alias("d")).collect()
    assert [tuple(r) for r in rules] == [
        ("refuse.scope_widen_not_landed", "refuse.scope_widen_needs_human", "refuse.scope_agent_cannot_widen", "refuse.scope_global_unreachable"),
        ("scope.branch_to_repository.landed", "refuse.scope_widen_needs_human", "refuse.scope_agent_cannot_widen", "refuse.scope_global_unreachable"),
        ("refuse.scope_narrowing", "refuse.scope_narrowing", "refuse.scope_narrowing", "refuse.scope_global_unreachable"),
    ]
