"""Requests upon records: what each may do, who may withdraw, and what is kept of it."""

from datetime import datetime

import duckdb
import pytest


from evidentia.operators import lifecycle as L
from evidentia.operators import projections as PR

from evidentia.plans import queries as core
from evidentia.plans import records as _plans  # noqa: F401  registers its queries

EVIDENCE = "array<struct<seq: bigint, event_id: string, event_type: string, source: string, command: string, reviewer: string, commit_sha: string, recorded_at: timestamp_ntz, linked: boolean, target: string>>"
RECORDS = f"memory_id string, project_id string, memory_type string, trust_state string, integration_state string, poisoning_risk double, author_agent string, command string, invalid_at timestamp_ntz, evidence {EVIDENCE}"
REQUESTS = "memory_id string, seq long, action string, target string, source string, project_id string, recorded_at timestamp_ntz, extra string"


def at(day):
    return datetime(2024, 1, day)


def passed(day, seq=1):
    return (seq, f"e{seq}", "verification.passed", "kernel", "make", None, None, at(day), True, None)


def record(name, state="observed", evidence=None, kind="episodic"):
    return (name, "p", kind, state, "none", 0.0, "a", "make", None, evidence)


@pytest.fixture(scope="module")
def run(spark):
    def told(records, requests):
        r = spark.createDataFrame(records, RECORDS)
        h = L.history(r, spark.createDataFrame([(*x, at(x[1] % 27 + 1), "x") for x in requests], REQUESTS))
        rows = {(x.memory_id, x.seq): (x.from_state, x.to_state, x.allowed, x.rule) for x in h.collect()}
        return rows, {x.memory_id: (x.trust_state, x.invalid_at) for x in L.applied(r, h).collect()}

    return told


def test_only_people_and_the_kernel_withdraw_and_only_their_own(run):
    rows, states = run(
        [record("m", "verified"), record("n", "verified")],
        [("m", 1, "reject", None, "agent", "p"), ("m", 2, "invalidate", None, "import", "p"), ("m", 3, "reject", None, "human", "other"), ("m", 4, "supersede", None, "adapter", "p"), ("n", 5, "reject", None, "human", "p"), ("n", 6, "reject", None, "human", "p"), ("n", 7, "promote", "verified", "human", "p")],
    )
    assert [rows["m", i][2:] for i in (1, 2, 3, 4)] == [(False, L.REFUSE_SOURCE), (False, L.REFUSE_SOURCE), (False, L.REFUSE_PROJECT), (False, L.REFUSE_SOURCE)]
    assert rows["n", 5] == ("verified", "rejected", True, "reject.human_or_kernel")
    assert rows["n", 6][2:] == (False, "refuse.already_terminal") and rows["n", 7][2:] == (False, "refuse.rejected_never_promoted")
    assert states == {"m": ("verified", None), "n": ("rejected", at(6))}


def test_an_invalidated_record_comes_back_on_newer_evidence_alone(run):
    old, new = record("old", "verified", [passed(1)]), record("new", "verified", [passed(28)])
    asks = [("invalidate", None, "human"), ("promote", "reviewed", "human"), ("promote", "verified", "agent"), ("promote", "verified", "kernel"), ("invalidate", None, "kernel")]
    rows, states = run([old, new], [(name, i + 2, action, target, source, "p") for name in ("old", "new") for i, (action, target, source) in enumerate(asks)])
    assert [rows["new", i][3] for i in range(2, 7)] == ["invalidate.human_or_kernel", "refuse.rung_skipped", "refuse.agent_cannot_promote", "revalidate.invalidated.fresh_evidence", "invalidate.human_or_kernel"]
    assert [rows["old", i][3] for i in range(2, 7)] == ["invalidate.human_or_kernel", "refuse.no_qualifying_evidence", "refuse.agent_cannot_promote", "refuse.no_qualifying_evidence", "refuse.already_terminal"]
    assert states["new"] == ("invalidated", at(7)) and states["old"] == ("invalidated", at(3))


def test_order_is_by_seq_and_a_climb_is_one_rung(run):
    rows, states = run([record("m", "quarantined", [passed(1)])], [("m", 9, "promote", "verified", "kernel", "p"), ("m", 3, "promote", "verified", "kernel", "p"), ("m", 5, "promote", "observed", "human", "p"), ("m", 7, "observe", "observed", "human", "p")])
    assert [rows["m", i][2:] for i in (3, 5, 7, 9)] == [(False, "refuse.rung_skipped"), (True, "promote.any.evidence_linked"), (False, L.REFUSE_ACTION), (True, "promote.any.verified_by_evidence")]
    assert states == {"m": ("verified", None)}


def test_a_record_with_most_requests_and_odd_rows(run):
    asks = [("hot", i, "invalidate" if i % 2 else "promote", "verified", "human", "p") for i in range(3000)]
    rows, states = run([record("hot", "observed", [passed(28)]), record("quiet", None)], [*asks, ("nobody", 1, "reject", None, "human", "p"), ("quiet", 1, "promote", None, "human", "p"), ("quiet", 2, None, None, "human", "p")])
    assert len(rows) == 3002 and rows["quiet", 1] == ("quarantined", None, False, "refuse.not_a_promotion") and rows["quiet", 2][3] == L.REFUSE_ACTION
    assert states["quiet"] == (None, None) and sum(x[2] for x in rows.values()) == 3000


def test_nothing(spark):
    r, q = spark.createDataFrame([], RECORDS), spark.createDataFrame([], REQUESTS)
    assert L.history(r, q).collect() == [] and L.applied(r, L.history(r, q)).collect() == []


def test_an_agents_branch_rejection_changes_nothing(spark):
    rows = [(1, "e1", "verification.passed", "kernel", "p", "t", "b", "make", None, None, "a", None, at(1), None, None)]
    for source, state in (("agent", "verified"), ("import", "verified"), ("adapter", "verified"), ("human", "rejected"), ("kernel", "rejected")):
        events = spark.createDataFrame([*rows, (2, "e2", "branch.rejected", source, "p", None, "b", None, None, None, None, None, at(2), None, None)], "seq long, event_id string, event_type string, source string, project_id string, task_id string, branch string, command string, purpose string, statement string, agent_profile string, commit_sha string, recorded_at timestamp_ntz, target string, reviewer string")
        assert {r.trust_state for r in PR.lives(PR.project(events), events).collect()} == {state}


def test_requested_changes_count_as_a_rejection(spark):
    schema = "seq long, event_id string, event_type string, source string, project_id string, task_id string, branch string, command string, purpose string, statement string, agent_profile string, commit_sha string, recorded_at timestamp_ntz, target string, reviewer string"
    passing = (1, "e1", "verification.passed", "kernel", "p", "t", "b", "make", None, None, "a", None, at(1), None, None)
    for verdict, state in (("approved", "approved"), ("rejected", "rejected"), ("changes_requested", "rejected")):
        events = spark.createDataFrame([passing, (2, "e2", f"review.{verdict}", "human", "p", "t", "b", None, None, None, None, None, at(2), None, "r")], schema)
        got = PR.lives(PR.project(events), events).where("event_id = 'e1' and memory_type = 'procedural'").first()
        assert (got.review_state, got.trust_state) == (state, "verified")


@pytest.mark.parametrize("name", ["transitions", "refusals", "withdrawals"])
def test_equal_to_recursive_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.sql(core.ORACLE_SQL[name])
    got = core.QUERIES[name](spark, sf).select(*expected.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, expected.fetchall()))
