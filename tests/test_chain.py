"""Hash chains by segments against plain Python, and what their audit finds."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.operators import journal as J
from evidentia.sources.driver_tables import journal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return journal(spark, SF)


@pytest.fixture(scope="module")
def chain(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chain") / "c")
    J.chained(events, segment=100).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def heads(spark, chain, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("heads") / "h")
    J.segment_heads(chain).write.parquet(path)
    return spark.read.parquet(path)


def test_hashes_equal_plain_python(events, chain, heads):
    rows = events.select("project_id", "seq", F.concat_ws("|", "event_id", "event_type", "task_id", "command", "statement").alias("p")).collect()
    last, count, expected = {}, defaultdict(int), set()
    for project, seq, p in sorted(rows, key=lambda r: r.seq):
        before = last.get((project, seq // 100), "")
        payload = hashlib.sha256(p.encode()).hexdigest()
        last[project, seq // 100] = hashlib.sha256(f"{before}|{payload}".encode()).hexdigest()
        count[project, seq // 100] += 1
        expected.add((project, seq, seq // 100, payload, before, last[project, seq // 100]))
    assert {tuple(r) for r in chain.collect()} == expected and len(rows) == len(expected) and len(last) > 10
    head, expected = {}, set()
    for project, segment in sorted(last):
        before, n, end = head.get(project, ""), count[project, segment], last[project, segment]
        head[project] = hashlib.sha256(f"{before}|{segment}|{n}|{end}".encode()).hexdigest()
        expected.add((project, segment, n, end, before, head[project]))
    assert {tuple(r) for r in heads.collect()} == expected


def broken(chain, heads):
    return sum(r.broken for r in J.audit(chain, heads).collect())


def test_audit_finds_what_is_changed_or_missing(events, chain, heads):
    assert broken(chain, heads) == 0
    first = chain.where("project_id = 'p1'").agg(F.min("segment")).first()[0]
    end = chain.where(f"project_id = 'p1' AND segment = {first}").agg(F.max("seq")).first()[0]
    assert broken(chain.where(f"NOT (project_id = 'p1' AND seq = {end})"), heads) == 1  # the last row of a segment
    assert broken(chain.where(f"NOT (project_id = 'p1' AND segment = {first})"), heads) == 1  # a whole segment
    assert broken(chain, heads.where(f"NOT (project_id = 'p1' AND segment = {first})")) == 2  # its head: missing, and the next one has lost its link
    rewritten = J.chained(events.withColumn("command", F.when(F.col("seq") == end, F.lit("x")).otherwise(F.col("command"))), segment=100)
    assert broken(rewritten, heads) == 1  # a segment chained anew follows in itself, but not from its head


def test_a_project_is_not_one_group(events):
    plan = J.chained(events)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "project_id" in plan and "segment" in plan
