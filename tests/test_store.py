"""A store that Engine.record has written: what an audit finds, who may publish, what a killed writer leaves; requests upon records."""

import glob
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from evidentia.engine import Engine
from evidentia.operators import journal as J
from evidentia.sources.store import Store, Taken

EVENTS = "event_id string, event_type string, source string, statement string, recorded_at timestamp_ntz"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store") / "s")
    engine = Engine(spark, folder, "p")
    engine.store.segment = 4
    for batch in range(3):
        engine.record(spark.range(10).select(F.concat(F.lit(f"e{batch}-"), "id").alias("event_id"), F.lit("fact.observed").alias("event_type"), F.lit("kernel").alias("source"), F.concat(F.lit("fact "), "id").alias("statement"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int))").alias("recorded_at")))
    return folder


@pytest.fixture
def copy(spark, written, tmp_path):
    shutil.copytree(written, tmp_path / "c")
    engine = Engine(spark, str(tmp_path / "c"), "p")
    engine.store.segment = 4
    return engine


def rewrite(engine, number, change, part="rows"):
    """Changes the rows of a batch behind the store's back."""
    (path,) = glob.glob(f"{engine.folder}/journal/{number:012d}-*")
    rows = engine.spark.read.parquet(f"{path}/{part}")
    change(rows).write.parquet(f"{path}/new")
    shutil.rmtree(f"{path}/{part}")
    os.rename(f"{path}/new", f"{path}/{part}")


def problems(engine):
    return {(r.batch, r.problem): r.n for r in engine.audit().collect()}


def test_nothing_is_wrong_and_numbers_follow(copy):
    assert problems(copy) == {}
    assert [r.seq for r in copy.journal().orderBy("seq").collect()] == list(range(1, 31))
    assert [(c["number"], c["n"], c["count"]) for c in copy.store.commits()] == [(1, 10, 10), (2, 10, 20), (3, 10, 30)]


def test_a_changed_payload_is_found(copy):
    rewrite(copy, 2, lambda r: r.withColumn("statement", F.when(F.col("seq") == 14, "other").otherwise(F.col("statement"))))
    assert problems(copy) == {(2, "payload"): 1}


def test_a_changed_time_is_found(copy):
    rewrite(copy, 1, lambda r: r.withColumn("recorded_at", F.when(F.col("seq") <= 2, F.lit("2030-01-01").cast("timestamp_ntz")).otherwise(F.col("recorded_at"))))
    assert problems(copy) == {(1, "payload"): 2}


def test_a_payload_changed_with_its_hash_breaks_the_chain(copy):
    rewrite(copy, 2, lambda r: r.withColumn("statement", F.when(F.col("seq") == 14, "other").otherwise(F.col("statement"))).withColumn("payload_hash", copy.store.payload()))
    assert problems(copy) == {(2, "chain"): 1}


def test_a_changed_hash_is_found(copy):
    rewrite(copy, 3, lambda r: r.withColumn("event_hash", F.when(F.col("seq") == 22, "0" * 64).otherwise(F.col("event_hash"))))
    assert problems(copy)[3, "chain"] >= 1


def test_a_lost_row_and_a_lost_tail_are_found(copy):
    rewrite(copy, 1, lambda r: r.where("seq <> 5"))
    rewrite(copy, 3, lambda r: r.where("seq < 29"))
    found = problems(copy)
    assert found[1, "size"] == found[1, "gap"] == 1 and found[1, "chain"] >= 1
    assert found[3, "size"] == found[3, "gap"] == 2 and found[3, "chain"] >= 1 and not any(b == 2 for b, _ in found)


def test_a_batch_chained_anew_or_lost_does_not_fit_its_neighbours(copy):
    (path,) = glob.glob(f"{copy.folder}/commits/*2.json")
    line = json.load(open(path))
    with open(path, "w") as f:
        f.write(json.dumps(line | {"own_head": "0" * 64}))
    for crc in glob.glob(f"{copy.folder}/commits/.*crc"):
        os.remove(crc)
    assert set(problems(copy)) == {(2, "head")} | {(2, "head")}
    os.remove(path)
    assert (3, "commit") in problems(copy)


def test_of_two_writers_one_is_refused_and_nothing_of_it_is_read(copy, spark):
    other = Engine(spark, copy.folder, "p")
    seen = other.store.commits()
    copy.record_fact("mine")
    late = spark.createDataFrame([("late", "fact.observed", "kernel", "theirs")], "event_id string, event_type string, source string, statement string")
    rows = other.store.read([]).unionByName(late.withColumn("seq", F.lit(31).cast("long")), allowMissingColumns=True).drop("batch", "segment", "payload_hash", "prev_hash", "event_hash")
    with pytest.raises(Taken):
        other.store.append(rows, seen)
    assert {r.statement for r in copy.journal().where("seq > 30").collect()} == {"mine"} and problems(copy) == {}
    other.record_fact("theirs, again")
    assert copy.journal().count() == 32 and problems(copy) == {}


def test_a_killed_writer_leaves_nothing(copy, monkeypatch):
    monkeypatch.setattr(Store, "_publish", lambda self, commit: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        copy.record_fact("lost")
    monkeypatch.undo()
    assert copy.journal().count() == 30 and problems(copy) == {}
    copy.record_fact("kept")
    assert copy.journal().count() == 31 and problems(copy) == {}


def test_events_sent_again_and_conflicts(copy, spark):
    again = copy.journal().where("seq <= 3").select("event_id", "event_type", "source", "statement", "recorded_at")
    assert copy.record(again).count() == 0 and len(copy.store.commits()) == 3
    with pytest.raises(ValueError, match="another payload"):
        copy.record(again.withColumn("statement", F.lit("x")))


def test_a_missing_hash_is_a_payload_of_its_own(spark):
    known = spark.createDataFrame([("a", "h"), ("b", None)], "event_id string, payload_hash string")
    new = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "x"), ("d", None)], "event_id string, payload_hash string")
    fresh, conflicts = J.append(known, new)
    assert [tuple(r) for r in fresh.collect()] == [("c", None)]
    assert sorted((r.event_id, r.payload_hash or "") for r in conflicts.collect()) == [("a", ""), ("d", ""), ("d", "x")]


def test_decisions_failures_and_requests(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"), "p")
    engine.record(
        spark.createDataFrame(
            [
                ("d1", "human.decision", "human", "Use postgres for storage", None, None, json.dumps({"rejected": ["mysql"], "rationale": "it is known"})),
                ("f1", "verification.failed", "kernel", None, "pytest -n auto", "timeout", None),
                ("f2", "verification.failed", "kernel", None, "pytest -n auto", "timeout", None),
                ("p1", "verification.passed", "kernel", None, "make lint", None, None),
                ("s1", "fact.observed", "kernel", "The port is 80", None, None, None),
            ],
            "event_id string, event_type string, source string, statement string, command string, error_kind string, payload string",
        ).withColumn("recorded_at", F.expr("timestamp_ntz'2024-01-01'"))
    )
    engine.reject("p1:procedural", "me", "flaky")
    engine.record_event("human.rejection", "agent", payload=json.dumps({"memory_id": "d1:decision"}))
    engine.supersede("s1:semantic", "The port is 81")
    engine.promote("s1:semantic", "verified", "me")
    told = {(r.memory_id, r.action): (r.to_state, r.allowed, r.rule) for r in engine.history().collect()}
    assert told["p1:procedural", "reject"] == ("rejected", True, "reject.human_or_kernel")
    assert told["d1:decision", "reject"][1:] == (False, "refuse.withdrawal_source")
    assert told["s1:semantic", "supersede"][:2] == ("superseded", True) and told["s1:semantic", "promote"][1:] == (False, "refuse.permanent_state")
    records = {r.memory_id: r for r in engine.memories().collect()}
    assert records["d1:decision"].trust_state == "integrated" and "Rejected: mysql." in records["d1:decision"].text
    assert records["p1:procedural"].trust_state == "rejected" and records["s1:semantic"].trust_state == "superseded"
    gotcha = next(r for r in records.values() if r.memory_type == "gotcha")
    assert gotcha.trust_state == "verified" and "pytest -n auto" in gotcha.text
    assert engine.recall("postgres storage").orderBy("rank").first().memory_id == "d1:decision"
    engine.drop_projections()
    assert not os.path.exists(f"{engine.folder}/projections") and engine.memories().count() == len(records)
    assert gotcha.memory_id in {r.memory_id for r in engine.recall("pytest auto").collect()}
