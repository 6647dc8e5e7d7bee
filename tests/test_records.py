"""Texts of failures, resolutions, appends, search, provenance, preflight, interchange, digest and streaming on small fixtures."""

import hashlib
import hmac
import json
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import records as R
from evidentia.functions import text as T
from evidentia.operators import digest, preflight
from evidentia.operators import journal as J
from evidentia.operators import memory as M
from evidentia.sources import jsonl
from evidentia.streaming import folds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalised_errors_in_all_scripts(spark):
    said = {"at /a/bé/c/d.py": "at <path>/d.py", "2024-01-02T03:04:05Z failed on line 12": "<ts> failed on line <n>", "took 12.5 ms, 3 MB at 0xdeadbeef": "took <dur>, <size> at <addr>", "sha 0123456789ab (x)": "sha <shorthash> (x)", "Écran 1٣٤": "écran <n>"}
    for text, shape in said.items():
        assert one(spark, T.normalize_error(F.lit(text))) == shape


def test_fingerprints(spark):
    cases = {
        "Traceback (most recent call last):\n  assert pool.acquire()\nE   TimeoutError: deadlock": "E   TimeoutError: deadlock", "note\nthe build failed here\nmore": "the build failed here", "---\n\nfirst\nsecond": "first",
        "PoolExhausted: none left": "PoolExhausted: none left", "": "", "===\n...": "", "error[E0308]: mismatched": "error[E0308]: mismatched", "x" * 900: "x" * 400,
    }
    for text, line in cases.items():
        assert one(spark, T.fingerprint(F.lit(text))) == line


def test_failure_texts(spark):
    text = T.gotcha_text(F.lit(" pytest "), F.lit("timeout"), F.lit("ValueError: bad"), F.lit("dev"))
    assert one(spark, text) == "`pytest` failed (timeout) on branch dev. ValueError: bad."
    assert one(spark, T.repeated_text(text, F.lit(3))) == "`pytest` failed (timeout) on branch dev. ValueError: bad. This has now failed twice. This has now failed 3 times."
    assert one(spark, T.repeated_text(text, F.lit(1))) == one(spark, text)
    none = F.lit("")
    assert one(spark, T.resolution_summary(F.lit("make fix"), F.lit("make"), none, F.lit("0123456789abcdef"), none, none)) == "make fix after commit 0123456789ab"
    assert one(spark, T.resolution_summary(F.lit("make  all"), F.lit("make all"), none, none, F.lit("2024"), none)) == "the same command passed, recorded 2024"
    assert one(spark, T.resolution_summary(none, F.lit("make"), none, F.lit("abc"), none, F.lit("main"))) == "work landed on main as commit abc"
    assert one(spark, T.one_line(F.lit(" a\n\tb  c "), 4)) == "a b…"
    assert one(spark, T.provenance_line(F.lit("passed"), F.lit("make"), F.lit("approved"), F.lit(True), F.lit("abc"), F.lit(2))) == "verified by `make`; approved in independent review; landed in abc; seen 2 times"


JOURNAL = "seq long, event_id long, recorded_at timestamp_ntz, project_id string, task_id string, run_id string, event_type string, command string, error_kind string, purpose string, branch string, resolves_signature string, signature string"


def journal(spark, rows):
    day = datetime(2024, 1, 1)
    full = [(i + 1, i + 1, day + timedelta(hours=i), "p", r.get("task", "t"), r.get("run"), f"verification.{r['kind']}", r["command"], r.get("error", "e"), r.get("purpose"), None, r.get("resolves"), r["command"] + "/" + r.get("error", "e") if r["kind"] == "failed" else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, JOURNAL)


def resolved(spark, rows):
    return {r.signature: r.resolved_by_event for r in J.resolutions(journal(spark, rows)).collect()}


def test_resolution_needs_a_link(spark):
    fail, ok = {"kind": "failed", "command": "lint"}, {"kind": "passed", "command": "serial"}
    assert resolved(spark, [fail, ok]) == {}  # the same task alone is no link
    assert resolved(spark, [fail, {**ok, "command": "lint"}]) == {"lint/e": 2}
    assert resolved(spark, [{**fail, "purpose": "Style"}, {**ok, "purpose": " style "}]) == {"lint/e": 2}
    assert resolved(spark, [{**fail, "purpose": ""}, {**ok, "purpose": ""}]) == {}
    assert resolved(spark, [{**ok, "command": "lint"}, fail]) == {}  # only later ones
    assert resolved(spark, [fail, {**ok, "command": "lint", "task": "u"}]) == {}
    assert resolved(spark, [fail, {**ok, "task": "u", "resolves": "lint/e"}]) == {"lint/e": 2}
    assert resolved(spark, [fail, {**fail, "error": "f"}, {**ok, "command": "lint", "resolves": "lint/f"}, {**ok, "command": "lint"}]) == {"lint/f": 3, "lint/e": 4}
    assert resolved(spark, [fail, {**ok, "command": "lint"}, fail, {**ok, "command": "lint"}]) == {"lint/e": 2}  # the first one stays
    assert resolved(spark, [{**fail, "task": None, "run": "r"}, {**ok, "command": "lint", "task": None, "run": "r"}]) == {"lint/e": 2}


def test_fold_describes_the_first_event(spark):
    rows = journal(spark, [{"kind": "failed", "command": "z", "error": "e"}, {"kind": "failed", "command": "a", "error": "e"}]).withColumn("signature", F.lit("s"))
    got = J.failure_fold(rows).first()
    assert (got.command, got.first_event_id, got.occurrences) == ("z", 1, 2)


def test_append(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, payload_hash string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "c"), (4, "x"), (4, "y")], "event_id long, payload_hash string")
    fresh, conflicts = J.append(old, new)
    assert sorted(map(tuple, fresh.collect())) == [(3, "c")]
    assert sorted(map(tuple, conflicts.collect())) == [(2, "x"), (4, "x"), (4, "y")]
    with pytest.raises(ValueError, match="2, 4"):
        J.append_all(old, new)
    assert J.append_all(old, new.where("event_id in (1, 3)")).count() == 1


MEMORY = "memory_id long, text string, subject_key string, project_id string"


def test_bm25_phrases_columns_and_accents(spark):
    rows = spark.createDataFrame([(1, "use -p no:xdist here", "", "a"), (2, "no such xdist", "", "a"), (3, "Élan VITAL élan", "k", "a"), (4, "", "no xdist", "a"), (5, "nothing", "", "a"), (6, None, None, "a"), (7, "other words", "", "a"), (8, "more words", "", "a")], MEMORY)
    got = {r.memory_id: r.raw for r in M.bm25(rows, ["no:xdist", "elan"], ("text", "subject_key")).collect()}
    assert set(got) == {1, 3, 4}

    def plain(tf, n, length, docs, mean):
        idf = np.log((docs - n + 0.5) / (n + 0.5))
        return max(idf, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))

    lengths = [5, 3, 4, 2, 1, 0, 2, 2]
    assert abs(got[3] - plain(2, 1, 4, 8, sum(lengths) / 8)) < 1e-12
    assert abs(got[1] - plain(1, 2, 5, 8, sum(lengths) / 8)) < 1e-12


@pytest.mark.parametrize("text", ["", "AND OR NOT NEAR", '"; DROP TABLE x; --', "a* ^b (c) NEAR/3 d", "no:xdist src/main.py c++", "x" * 9000, "é ü", '""""', "the is of"])
def test_query_terms_of_hostile_text(spark, text):
    terms = one(spark, T.query_terms(F.lit(text)))
    assert terms == M.search_terms(text)
    assert len(terms) <= 32 and all(len(t) <= 64 and '"' not in t and "*" not in t for t in terms)


RECORD = "memory_id long, text string, project_id string, branch string, repository_id string, scope_level string, memory_type string, trust_state string, verification_state string, review_state string, integration_state string, poisoning_risk double, age_days long, access_count long, recorded_at timestamp_ntz, invalid_at timestamp_ntz"


def record(i, text, project="p", state="verified", **more):
    row = {"branch": "b", "repository_id": None, "scope_level": "branch", "memory_type": "gotcha", "verification_state": "passed", "review_state": "none", "integration_state": "none", "poisoning_risk": 0.0, "age_days": 0, "access_count": 0, "recorded_at": datetime(2024, 1, 1), "invalid_at": None} | more
    return (i, text, project, row["branch"], row["repository_id"], row["scope_level"], row["memory_type"], state, row["verification_state"], row["review_state"], row["integration_state"], row["poisoning_risk"], row["age_days"], row["access_count"], row["recorded_at"], row["invalid_at"])


def test_recall_filters_the_project_before_the_candidates(spark):
    rows = [record(i, "needle needle needle", "other") for i in range(100)] + [record(1000 + i, "needle and more words " * (i + 1)) for i in range(3)] + [record(2000, "plain"), record(2001, "needle", state="rejected"), record(2002, "needle", invalid_at=datetime(2024, 2, 1))]
    frame = spark.createDataFrame(rows, RECORD)
    got = M.recall(frame, "needle", "p", cap=10, branch="b").orderBy("rank").collect()
    assert {r.memory_id for r in got} == {1000, 1001, 1002} and [r.rank for r in got] == [1, 2, 3]
    assert M.recall(frame, "of the", "p", cap=10).count() == 4  # browses


def test_recall_breaks_ties_by_time_then_id(spark):
    rows = [record(3, "needle"), record(2, "needle"), record(9, "needle", recorded_at=datetime(2024, 5, 1)), record(50, "straw")]
    got = M.recall(spark.createDataFrame(rows, RECORD), "needle", "p", branch="b").orderBy("rank").collect()
    assert [r.memory_id for r in got] == [9, 2, 3]


def test_lineage_upsert_and_provenance(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99), (7, 7), (8, 2)], "memory_id long, supersedes_id long")
    got = {r.memory_id: (r.root, r.steps, r.cycle) for r in M.lineage(links).collect()}
    assert got[3] == (1, 2, False) and got[1] == (1, 0, False) and got[4][2] and got[5][2] and got[7][2] and got[6] == (99, 1, False)
    assert [tuple(r) for r in M.divergent(links).collect()] == [(2, [3, 8])]
    assert {r.memory_id for r in M.dangling(links).collect()} == {6}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "memory_id long, text string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 3), (2, "z", 2), (3, "c", 1)], "memory_id long, text string, version int")
    assert sorted(map(tuple, M.upsert(old, new, "version").collect())) == [(1, "a"), (2, "y"), (3, "c")]


def test_applicability(spark):
    commits = spark.createDataFrame([("c2", "c1"), ("c3", "c2"), ("s1", "c1"), ("c1", None), ("m", "c3"), ("m", "s1")], "child string, parent string")
    rows = spark.createDataFrame([(1, "c1"), (2, "s1"), (3, None), (4, "gone"), (5, "c3")], "memory_id long, commit_sha string")
    got = {r.memory_id: r.applicability for r in M.applicability(rows, "c3", commits, F.lit("current")).collect()}
    assert got == {1: "current", 2: "historical", 3: "current", 4: "uncertain", 5: "current"}
    assert {r.applicability for r in M.applicability(rows, "m", commits, F.lit("current")).where("memory_id in (1, 2, 5)").collect()} == {"current"}
    assert {r.applicability for r in M.applicability(rows, "lost", commits, F.lit("current")).where("commit_sha is not null").collect()} == {"uncertain"}
    got = {r.memory_id: r.applicability for r in M.applicability(rows, None, None, F.lit("current")).collect()}
    assert got[3] == "current" and got[1] == "uncertain"


def test_preflight_tiers(spark):
    ask = "proposal_id long, project_id string, command string, error_kind string, error_text string, subsystem string"
    asked = spark.createDataFrame([(1, "p", "make x", "timeout", "TimeoutError: 1", ""), (2, "p", "make x", "", "", ""), (3, "p", "use pytest-xdist", "", "", ""), (4, "p", "", "", "", "db pool"), (5, "q", "make x", "", "", ""), (6, "p", "", "", "", "b pool")], ask)
    signature = one(spark, T.failure_signature(F.lit("make x"), F.lit("timeout"), F.lit("TimeoutError: 1")))
    failures = spark.createDataFrame([("p", "m1", signature, "make x", 3, "current"), ("p", "m2", "other", "make x", 5, "historical"), ("p", "m3", "third", "run db/pool tests", 1, "uncertain")], "project_id string, memory_id string, signature string, command string, occurrences long, applicability string")
    decisions = spark.createDataFrame([("p", "d1", "Pytest-XDist"), ("p", "d2", "zz")], "project_id string, memory_id string, alternative string")
    got = {(r.proposal_id, r.memory_id): r for r in preflight.matches(asked, failures, decisions).collect()}
    assert set(got) == {(1, "m1"), (1, "m2"), (2, "m1"), (2, "m2"), (3, "d1"), (4, "m3")}
    assert (got[1, "m1"].tier, got[1, "m1"].confidence, got[1, "m1"].blocks) == ("signature", 1.0, True)
    assert (got[2, "m1"].tier, got[2, "m1"].blocks, got[2, "m2"].confidence) == ("command", False, 0.51)
    assert got[3, "d1"].tier == "alternative" and (got[4, "m3"].tier, got[4, "m3"].confidence) == ("overlap", 0.44)


def test_records_as_lines(spark, tmp_path):
    rows = spark.createDataFrame([(3, "p", "x", None), (1, "p", "é\n", "b"), (2, "q", "y", None)], "memory_id long, project_id string, text string, branch string")
    lines = jsonl.encoded(rows, "memory", "memory_id", "project_id", text="text", branch="branch")
    jsonl.export(lines, str(tmp_path / "out"))
    said = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert all(list(x) == sorted(x) for x in said) and "branch" not in json.loads(next(x["payload"] for x in said if x["id"] == "3"))
    good = [json.dumps(x) for x in said]
    stale = dict(said[0], payload=said[0]["payload"].replace("{", '{"z":1,', 1))
    bad = ["", "{", "7", json.dumps(stale), json.dumps(dict(said[0], version=9)), "x" * (jsonl.LINE_BYTES + 1)]
    spark.createDataFrame([(x,) for x in good + bad], "value string").write.text(str(tmp_path / "in"))
    found, issues = jsonl.read(spark, str(tmp_path / "in"), "p")
    assert sorted(r.id for r in found.collect()) == ["1", "3"]
    assert sorted(r.issue for r in issues.collect() if r.issue != "hash_mismatch")[-4:] == ["future_version", "line_too_long", "malformed", "malformed"]
    assert {r.issue for r in issues.collect()} == {"foreign_project", "future_version", "line_too_long", "malformed"} | ({"hash_mismatch"} if said[0]["project_id"] == "p" else set())
    known = spark.createDataFrame([("1", next(x["hash"] for x in said if x["id"] == "1"))], "id string, hash string")
    got = {r.id: (r.outcome, r.source, r.trust_state) for r in jsonl.decoded(jsonl.compared(found, known)).collect()}
    assert got == {"1": ("duplicate", "import", "quarantined"), "3": ("new", "import", "quarantined")}


def test_signatures_identifiers_vectors(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, R.signature(F.lit("é record"), key)) == hmac.new(key, "é record".encode(), hashlib.sha256).hexdigest()
        assert not one(spark, R.verified(F.lit("r"), F.lit(None).cast("string"), key))
    assert one(spark, R.id_millis(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == 1469922850259
    assert one(spark, R.id_millis(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAU"))) is None
    rows = spark.createDataFrame([("Words, words and more",), ("",), (None,)], "t string").withColumn("v", R.hash_embedding(F.col("t"))).withColumn("w", R.unpacked(R.packed(F.col("v")))).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and rows[0].v == rows[0].w and sum(map(abs, rows[1].v)) == 0


def test_a_landing_may_declare_what_it_resolves(spark):
    rows = journal(spark, [{"kind": "failed", "command": "make"}, {"kind": "failed", "command": "lint"}, {"kind": "passed", "command": "other", "task": "u", "resolves": " make/e "}])
    landed = rows.withColumn("event_type", F.when(F.col("seq") == 3, "integration.landed").otherwise(F.col("event_type")))
    found = lambda x: {r.signature: r.resolved_by_event for r in J.resolutions(x).collect()}
    assert found(landed) == found(rows) == {"make/e": 3}
    assert found(landed.withColumn("resolves_signature", F.lit(""))) == {}  # a landing that names nothing resolves nothing


def test_repeated_payloads(spark):
    said = [(1, "p", "fact", "a", None), (2, "p", "fact", "a", None), (3, "p", "fact", "a", ""), (4, "q", "fact", "a", None), (5, "p", "fac", "ta", None), (6, "p", None, None, None), (9, "p", None, None, None)]
    rows = spark.createDataFrame(said, "seq long, project_id string, event_type string, command string, branch string")
    got = {(r.project_id, r.n, r.first_seq, r.last_seq) for r in J.repeated_payloads(rows, ("event_type", "command", "branch")).collect()}
    assert got == {("p", 2, 1, 2), ("p", 2, 6, 9)}
    assert J.repeated_payloads(rows.limit(0), ("event_type",)).collect() == []


def test_digest_never_exceeds_its_budget(spark):
    rows = [(i, ("gotcha", "semantic", "decision", "episodic")[i % 4], f"text {i % 7} " + "x" * (i * 13 % 90), "VERIFIED", "", ["NOT established project truth"] if i % 3 else []) for i in range(14)]
    frame = spark.createDataFrame(rows, "memory_id int, memory_type string, text string, label string, provenance string, warnings array<string>").coalesce(1)

    class Answer:
        def __init__(self, found):
            self.found = found

        def limit(self, n):
            return self

        def collect(self):
            return self.found

    found = frame.collect()
    full = digest.compose(frame, 4000)
    assert full.omitted == 0 and len(full.included) + full.duplicates == 14 and full.warnings
    for budget in range(len(digest.BANNER) + 1 + digest.RESERVE, 1500, 7):
        d = digest.compose(Answer(found), budget)
        assert len(d.text) <= budget and d.text.startswith(digest.BANNER)
        assert len(d.included) + d.omitted + d.duplicates == 14 and (d.omitted == 0 or "further record" in d.text)
    with pytest.raises(ValueError):
        digest.compose(frame, 50)


def test_digests_of_many_queries_equal_each_alone(spark):
    kinds = ("gotcha", "semantic", "decision", "episodic", "unknown")
    rows = [(f"q{i % 3}", i // 3, i, kinds[i % 5], None if i == 4 else f"text {i % 7} " + "x" * (i * 13 % 90), "VERIFIED", "", None if i == 5 else ["NOT established"] if i % 2 else [], "x") for i in range(60)]
    rows += [("hot", 5, 1000 + i, kinds[i % 4], f"t{i}", "OBSERVED", "p", [], "x") for i in range(450)]  # ties by rank
    frame = spark.createDataFrame(rows, "query_id string, rank int, memory_id int, memory_type string, text string, label string, provenance string, warnings array<string>, nth string")
    got = {r.query_id: r for r in digest.digests(frame, 900).collect()}
    assert set(got) == {"q0", "q1", "q2", "hot"}
    names = ("memory_id", "memory_type", "text", "label", "provenance", "warnings")
    for name, r in got.items():
        mine = sorted((x for x in rows if x[0] == name), key=lambda x: (x[1], x[2]))[: digest.ROWS]
        alone = digest.composed([dict(zip(names, (x[2], x[3], x[4] or "", *x[5:8]))) for x in mine], 900)
        assert (r.text, r.included, r.omitted, r.duplicates, r.warnings) == (alone.text, alone.included, alone.omitted, alone.duplicates, alone.warnings)
        assert len(r.text) <= 900 and len(mine) == len(r.included) + r.omitted + r.duplicates
    assert len([x for x in rows if x[0] == "hot"]) > digest.ROWS and got["hot"].included[0] == 1000
    assert digest.digests(frame.limit(0), 900).collect() == []


def test_vector_queries_of_several_pages(spark):
    from evidentia.operators import memory as M

    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 7) - 3.0, 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 2 = 1")
    rows = lambda page: sorted(map(tuple, M.vector_search(vectors, vectors.where("vec_id < 40"), asked, 3, page).collect()))
    assert rows(7) == rows(1000) and len(rows(7)) == 90 and len({r[0] for r in rows(7)}) == 30


def test_stream_equals_rebuild(spark, tmp_path):
    rows = journal(spark, [{"kind": "failed", "command": f"c{i % 3}", "error": f"e{i % 2}"} for i in range(40)])
    late = rows.orderBy(F.desc("seq")).limit(25).union(rows.limit(5))  # out of order, and some again
    for i, part in enumerate((late, rows.where("seq <= 20"), rows)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    folds.start_fold(events, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted(map(tuple, folds.folded(spark, str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, folds.merged_fold(folds.partial_fold(rows)).collect()))
    folds.start_fold(events, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()  # nothing new
    assert got == sorted(map(tuple, folds.folded(spark, str(tmp_path / "out")).collect()))


def test_rate_limit_against_plain(spark):
    start = datetime(2024, 1, 1)
    calls = [(f"c{i % 3}", i, start + timedelta(seconds=(i * 37) % 900)) for i in range(300)]
    got = {r.call_id: r.allowed for r in folds.rate_limited(spark.createDataFrame(calls, "client string, call_id long, at timestamp_ntz"), 4, 60).collect()}
    for client in ("c0", "c1", "c2"):
        times = deque()
        for _, i, at in sorted((c for c in calls if c[0] == client), key=lambda c: (c[2], c[1])):
            while times and times[0] <= at - timedelta(seconds=60):
                times.popleft()
            assert got[i] == (len(times) < 4)
            if got[i]:
                times.append(at)


def test_vector_search_keeps_a_few_rows_a_task_and_loses_none(spark):
    """Copies, ties, zeros, nulls and vectors of other lengths rank as comparing all rows does; what leaves the tasks does not grow with queries x vectors."""
    import random

    from pyspark.sql import Window

    from evidentia.operators import memory as M

    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(4)]) for i in range(700)]
    rows += [(700 + i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1300)] + [(2000 + i, [0.0] * 4) for i in range(30)]
    odd = [(2100, [1.0, None, 1.0, 1.0]), (2101, [1.0, 2.0]), (2102, None), (2103, [float("inf"), 1.0, 1.0, 1.0]), (2104, [1e-160, 1e-160, 0.0, 0.0]), (2105, [float("nan"), 1.0, 1.0, 1.0])]
    repeated = [(0, [2.0, 2.0, -1.0, 0.5])]
    for vectors in (rows, rows + odd + repeated):
        frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
        asked = frame.where("vec_id % 50 = 0 or vec_id > 2098")
        plain = frame.where("vec_id % 3 <> 1").crossJoin(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))).where("vec_id <> query_id")
        plain = plain.withColumn("c", M.cosine(F.col("embedding"), F.col("asked")))
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("c", 9)), "vec_id")
        expected = plain.withColumn("rank", F.row_number().over(w)).where("rank <= 7").select("query_id", "vec_id", F.round("c", 6), "rank")
        got = M.vector_search(frame, frame.where("vec_id % 3 <> 1"), asked, 7, 9)
        key = lambda r: (r[0], r[3])
        assert str(sorted(map(tuple, got.collect()), key=key)) == str(sorted(map(tuple, expected.collect()), key=key))
    assert M.vector_search(frame, frame, frame.limit(0)).count() == 0 and M.vector_search(frame.limit(0), frame, asked).count() == 0

    class Task:
        batches = spark.createDataFrame(rows, "vec_id long, embedding array<double>").toArrow().to_batches(max_chunksize=500)

    left = list(M._nearest(iter(Task.batches), np.arange(20), np.array([r[1] for r in rows[:20]]), 7))
    assert sum(x.num_rows for x in left) < 20 * 7 * 12
