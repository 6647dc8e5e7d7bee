"""Every core query against its SQL, and the operators' edge cases."""

import decimal

import duckdb
import pytest

from evidentia.functions.text import normalize_error, subject_key
from evidentia.operators import journal as J
from evidentia.plans import records as _records  # noqa: F401  registers more queries
from evidentia.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def _rows(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sql, name):
    frame = QUERIES[name](spark, SF)
    expected = sql.sql(ORACLE_SQL[name])
    assert _rows([tuple(r) for r in frame.collect()], frame.columns) == _rows(expected.fetchall(), expected.columns)


def test_normalize_error(spark):
    rows = {
        "Error at 2024-01-02T03:04:05.123Z in /tmp/abc/x": "error at <ts> in <tmp>",
        "failed /home/u/proj/file.py line 42": "failed <path>/file.py line <n>",
        "took 3.5 seconds, 12 KB, exit 1": "took <dur>, <size>, exit 1",
    }
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", normalize_error("t").alias("n")).collect()
    assert {r.t: r.n for r in got} == rows


def test_subject_key(spark):
    rows = {"The project uses uv.": "project uses", "ci is on": "ci", "": "", "the of": ""}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", subject_key("t").alias("n")).collect()
    assert {r.t: r.n for r in got} == rows


def test_chain_finds_tampering(spark):
    chain = J.chained(QUERIES_JOURNAL(spark))
    assert J.broken_links(chain).count() == 0
    from pyspark.sql import functions as F

    bad = chain.withColumn("payload_hash", F.when(F.col("seq") == 7, F.lit("x")).otherwise(F.col("payload_hash")))
    assert J.broken_links(bad).count() == 1


def QUERIES_JOURNAL(spark):
    from evidentia.sources.driver_tables import journal

    return journal(spark, SF)


def test_append_drops_known_and_reports_conflicts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, payload_hash string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d"), (3, "d")], "event_id long, payload_hash string")
    fresh, conflicts = J.append(old, new)
    assert [r.event_id for r in fresh.collect()] == [3]
    assert [r.event_id for r in conflicts.collect()] == [2]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
