"""The engine's data model over the driver tables: an event journal and memory records, by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import failure_signature


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal rows in ``seq`` order of event_id."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            F.col("event_id").alias("seq"),
            "event_id",
            F.col("ts").alias("recorded_at"),
            F.concat(F.lit("p"), F.col("user_id") % 5).alias("project_id"),
            F.concat(F.lit("agent-"), F.col("user_id")).alias("agent_profile"),
            F.concat(F.lit("task-"), (F.col("user_id") * 7 + F.col("k")) % 50).alias("task_id"),
            F.concat(F.lit("cmd-"), F.col("k") % 20).alias("command"),
            F.when(F.col("k") % 3 == 0, "timeout").when(F.col("k") % 3 == 1, "assertion").otherwise("import").alias("error_kind"),
            F.when(kind == "error", "verification.failed")
            .when(kind == "purchase", "verification.passed")
            .when(kind == "signup", "attempt.completed")
            .when(kind == "click", "review.approved")
            .otherwise("fact.observed")
            .alias("event_type"),
            F.when(F.col("user_id") % 10 == 0, "agent").when(F.col("user_id") % 10 == 1, "import").when(F.col("user_id") % 10 == 2, "human").otherwise("kernel").alias("source"),
            F.concat(F.lit("run-"), F.col("user_id") % 11).alias("run_id"),
            F.when(F.col("k") % 4 < 3, F.concat(F.lit("b-"), F.col("k") % 4)).alias("branch"),
            F.when(F.col("k") % 6 < 5, F.concat(F.lit("goal-"), F.col("k") % 6)).alias("purpose"),
            F.concat(F.lit("adapter-"), F.col("user_id") % 2).alias("adapter"),
            F.when(F.col("event_id") % 5 == 0, F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12)).alias("commit_sha"),
            F.when((kind == "purchase") & (F.col("event_id") % 40 < 8), failure_signature(F.concat(F.lit("cmd-"), (F.col("k") + 7) % 20), F.lit("timeout"))).alias("resolves_signature"),
            F.concat(F.lit("s-"), F.col("k")).alias("subject_key"),
            F.floor(F.col("value") / 50).cast("long").alias("statement"),
            (F.col("value") < 150).alias("ok"),
        )
        .withColumn("signature", failure_signature("command", "error_kind"))
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels as memory records."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    i = F.col("doc_id")
    m = i % 6
    trust = F.when(F.col("toxic") == 1, "quarantined").when(F.col("quality") == 0, "rejected").when(F.col("quality") == 1, F.when(i % 3 == 0, "integrated").otherwise("verified")).otherwise("observed")
    recorded = F.expr("timestamp_ntz'2024-06-01' - make_dt_interval(cast(doc_id % 97 as int))")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .withColumn("trust_state", trust)
        .select(
            i.alias("memory_id"),
            "text",
            F.col("lang").alias("project_id"),
            F.when(i % 11 != 0, F.col("source")).alias("branch"),
            F.when(m == 0, "episodic").when(m == 1, "semantic").when(m == 2, "procedural").when(m == 3, "decision").when(m == 4, "gotcha").otherwise("performance").alias("memory_type"),
            "trust_state",
            F.when(F.col("toxic") == 1, 0.6).otherwise(0.0).alias("poisoning_risk"),
            (i % 97).alias("age_days"),
            (i % 53).alias("access_count"),
            F.when(i % 7 == 0, "project").when(i % 7 == 1, "repository").otherwise("branch").alias("scope_level"),
            F.when(i % 4 < 3, F.concat(F.lit("repo-"), i % 4)).alias("repository_id"),
            F.concat(F.lit("run-"), i % 13).alias("run_id"),
            F.concat(F.lit("task-"), i % 50).alias("task_id"),
            F.concat(F.lit("agent-"), i % 9).alias("author_agent"),
            F.concat(F.lit("cmd-"), i % 20).alias("command"),
            F.when(i % 5 == 0, F.concat(F.lit("c"), i % 40)).alias("commit_sha"),
            recorded.alias("recorded_at"),
            F.when(i % 17 == 0, recorded + F.expr("interval '3' day")).alias("invalid_at"),
            F.when(i % 3 == 0, "passed").when(i % 3 == 1, "failed").otherwise("unknown").alias("verification_state"),
            F.when(i % 5 == 1, "approved").when(i % 5 == 2, "rejected").otherwise("none").alias("review_state"),
            F.when(F.col("trust_state") == "integrated", F.when(i % 2 == 0, "accepted_user").otherwise("integrated_run")).otherwise("none").alias("integration_state"),
            F.when((i % 10).isin(1, 2, 3), i - 1).when(i % 10 == 4, i - 2).when(i % 50 == 7, -i).alias("supersedes_id"),
            F.array(i, i * 11 + 5).alias("source_event_ids"),
        )
    )


def commits(spark: SparkSession) -> DataFrame:
    """A small history: c1 .. c29 in line, c30 .. c34 a side branch of c10; c35 and later are unknown."""
    line = F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 30, F.lit("c10")).otherwise(F.concat(F.lit("c"), F.col("id") - 1))
    return spark.range(1, 35).select(F.concat(F.lit("c"), F.col("id")).alias("child"), line.alias("parent"))


# Error codes of a host program and the kinds they are.
ERROR_KINDS = {"TIMEOUT": "timeout", "VERIFY_FAILED": "test_failure", "POLICY_VIOLATION": "policy_violation", "ADAPTER_ERROR": "adapter_error", "MERGE_CONFLICT": "merge_conflict", "QUOTA_EXHAUSTED": "quota", "CANCELLED": "cancelled"}


def adapted(rows: DataFrame) -> DataFrame:
    """Rows of a host program (``status, error_code, category`` and journal columns) as adapter events; unknown codes stay as they are."""
    kinds = F.create_map(*(F.lit(x) for pair in ERROR_KINDS.items() for x in pair))
    code = F.coalesce("error_code", F.lit(""))
    kind = F.when(F.col("status") == "passed", "verification.passed").when(F.col("status") == "failed", "verification.failed").otherwise("attempt.completed")
    return rows.withColumns({"event_type": kind, "source": F.lit("adapter"), "error_kind": F.coalesce(F.try_element_at(kinds, code), code), "category": F.coalesce("category", F.lit("general"))}).drop("status", "error_code")
