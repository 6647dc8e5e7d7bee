"""Records of events, and what later events make of them, as set operations over the whole journal.

A record's life is told by the nearest events after its birth: reviews, landings, reverts and rejected branches meet records
on a task or a branch. Records and events of a key stand in one sequence with a running minimum or maximum, so that a key
costs a row an event, and a rebuild is a few sorts instead of a replay event by event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import subject_key
from evidentia.operators import trust
from evidentia.operators.lifecycle import WITHDRAWAL_SOURCES

# Types whose records say something about the code, and the words of an episode.
CLAIMS = ("semantic", "procedural", "decision")
EPISODES = {
    "verification.passed": "verification passed", "verification.failed": "verification FAILED", "command.succeeded": "command succeeded", "command.failed": "command FAILED", "attempt.completed": "attempt completed",
    "task.completed": "task completed", "run.completed": "run completed", "review.approved": "review approved", "review.rejected": "review REJECTED", "review.changes_requested": "review requested changes",
    "integration.landed": "integration landed", "integration.reverted": "integration reverted",
}


def episode_text(kind: Column) -> Column:
    verb = kind
    for name, said in EPISODES.items():
        verb = F.when(kind == name, said).otherwise(verb)
    named = F.when(F.coalesce(F.trim("command"), F.lit("")) != "", F.concat(F.lit("`"), F.trim("command"), F.lit("`")))
    return F.concat(F.concat_ws(" ", verb, named, F.concat(F.lit("by "), F.col("agent_profile")), F.concat(F.lit("on "), F.col("branch")), F.concat(F.lit("at "), F.substring("commit_sha", 1, 12))), F.lit("."))


def procedure_text() -> Column:
    return F.concat(F.concat_ws(" ", F.concat(F.lit("`"), F.trim("command"), F.lit("` succeeded")), F.concat(F.lit("for "), F.col("purpose")), F.concat(F.lit("on branch "), F.col("branch"))), F.lit("."))


def decision_text(selected: Column, rejected: Column, rationale: Column, authority: Column) -> Column:
    return F.concat_ws(
        " ", F.concat(F.lit("Decision: "), selected, F.lit(".")), F.when(F.size(rejected) > 0, F.concat(F.lit("Rejected: "), F.array_join(rejected, ", "), F.lit("."))),
        F.when(rationale != "", F.concat(F.lit("Rationale: "), rationale)), F.when(authority != "", F.concat(F.lit("(decided by "), authority, F.lit(")"))),
    )


def project(events: DataFrame) -> DataFrame:
    """The records that each event makes by itself: episodes, procedures, decisions and facts, with the rung that its own evidence allows.

    events: ``seq, event_id, event_type, source, project_id, task_id, branch, command, purpose, statement, agent_profile, commit_sha, recorded_at``, and
    ``payload`` (a decision's rejected alternatives, rationale and authority) if there is one.
    Failures fold by signature (``journal.failure_fold``), attempts by agent (``journal.performance``).
    """
    kind = F.col("event_type")
    start = trust.initial_state(F.col("source"), F.lit(0.0))
    trusted = F.col("source").isin(*trust.TRUSTED_SOURCES)
    said = F.concat_ws(" ", "command", "purpose")

    def entry(test: Column, name: str, text: Column, climbs: Column, verification: Column, subject: Column, to: str = "verified") -> Column:
        return F.when(test, F.struct(F.lit(name).alias("memory_type"), text.alias("text"), F.when(climbs & trusted, to).otherwise(start).alias("trust_state"), verification.alias("verification_state"), subject.alias("subject_key")))

    result = F.when(kind.isin(*trust.PASSES), "passed").when(kind.isin(*trust.FAILURES), "failed").otherwise("unknown")
    payload = F.col("payload") if "payload" in events.columns else F.lit(None).cast("string")

    def field(name: str) -> Column:
        return F.coalesce(F.trim(F.get_json_object(payload, f"$.{name}")), F.lit(""))

    rejected = F.coalesce(F.from_json(F.get_json_object(payload, "$.rejected"), "array<string>"), F.array().cast("array<string>"))
    decided = decision_text(F.trim("statement"), rejected, field("rationale"), field("authority"))
    has_command, has_statement = F.coalesce(F.trim("command"), F.lit("")) != "", F.coalesce(F.trim("statement"), F.lit("")) != ""
    made = F.array_compact(
        F.array(
            entry(kind.isin(*EPISODES), "episodic", episode_text(kind), kind.isin(*trust.VERIFICATIONS), result, F.lit("")),
            entry(kind.isin(*trust.PASSES) & has_command, "procedural", procedure_text(), F.lit(True), F.lit("passed"), subject_key(said)),
            # A person's decision rests on their authority and climbs every rung at once.
            entry((kind == "human.decision") & has_statement, "decision", decided, F.col("source") == "human", F.lit("unknown"), subject_key(F.col("statement")), "integrated"),
            entry(kind.isin("fact.observed", "fact.changed", "agent.observation") & has_statement, "semantic", F.col("statement"), F.lit(False), F.lit("unknown"), subject_key(F.col("statement"))),
        )
    )
    rows = events.select("seq", "event_id", "project_id", "task_id", "branch", F.col("agent_profile").alias("author_agent"), "commit_sha", "recorded_at", F.explode(made).alias("r"))
    return rows.select(F.concat_ws(":", "event_id", "r.memory_type").alias("memory_id"), *rows.columns[:-1], "r.*")


def stats(records: DataFrame) -> DataFrame:
    """How many records of each type a projection has made, in which state and how many events it took: ``memory_type, trust_state, records, events, last_seq``."""
    return records.groupBy("memory_type", "trust_state").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("event_id").alias("events"), F.max("seq").alias("last_seq"))


def _nearest(rows: DataFrame, events: DataFrame, keys: list[str], at: str, later: bool) -> DataFrame:
    """``memory_id, event``: of each row the first event with its keys after ``at``, or the last one before. An event is a struct that starts with seq."""
    keyed = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    left = rows.where(keyed).select(*keys, F.col(at).alias("s"), "memory_id", F.lit(None).cast(events.schema["event"].dataType).alias("event"))
    right = events.where(keyed).select(*keys, F.col("event.seq").alias("s"), F.lit(None).cast("string").alias("memory_id"), "event")
    w = Window.partitionBy(*keys).orderBy(F.desc("s") if later else F.asc("s"), F.col("memory_id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("event") if later else F.max("event")
    met = left.union(right).withColumn("event", best.over(w)).where(F.col("memory_id").isNotNull() & F.col("event").isNotNull())
    return met.select("memory_id", "event")


def lives(records: DataFrame, events: DataFrame) -> DataFrame:
    """Records after all later events: ``trust_state, review_state, integration_state, commit_sha, invalid_at, invalid_seq``.

    events: ``seq, event_type, source, project_id, task_id, branch, target, commit_sha, reviewer, recorded_at`` of reviews, landings, reverts and
    rejected branches; only people and the kernel may reject a branch, other sources' rejections change nothing. The first withdrawal after a record's birth ends its life: a revert for claims of its task or branch, a rejected branch for every record of it.
    Before that, the last landing gives its commit and state; the last review of its task (of its branch, if it names no task) its verdict.
    """
    entry = F.struct("seq", "event_type", "target", "commit_sha", "reviewer", "recorded_at", "task_id")
    events = events.where((F.col("event_type") != "branch.rejected") | F.col("source").isin(*WITHDRAWAL_SOURCES))
    said = events.select("project_id", "task_id", "branch", "event_type", entry.alias("event"))
    claim = F.col("memory_type").isin(*CLAIMS)
    claims, by_task, by_branch = records.where(claim), ["project_id", "task_id"], ["project_id", "branch"]

    def of(*kinds: str) -> DataFrame:
        return said.where(F.col("event_type").isin(*kinds))

    ends = [_nearest(claims, of("integration.reverted"), by_task, "seq", True), _nearest(claims, of("integration.reverted"), by_branch, "seq", True), _nearest(records, of("branch.rejected"), by_branch, "seq", True)]
    end = reduce(DataFrame.union, ends).groupBy("memory_id").agg(F.min("event").alias("end"))
    rows = records.join(end, "memory_id", "left").withColumn("until", F.coalesce("end.seq", F.lit(2**62)))
    claims = rows.where(claim)
    found = [_nearest(claims, of("integration.landed"), k, "until", False) for k in (by_task, by_branch)]
    landing = reduce(DataFrame.union, found).groupBy("memory_id").agg(F.max("event").alias("landing"))
    reviews = of("review.approved", "review.rejected", "review.changes_requested")
    found = [_nearest(claims, reviews, by_task, "until", False), _nearest(claims, reviews.where("task_id is null"), by_branch, "until", False)]
    review = reduce(DataFrame.union, found).groupBy("memory_id").agg(F.max("event").alias("review"))
    rows = rows.join(landing, "memory_id", "left").join(review, "memory_id", "left")

    after = lambda c: F.coalesce(F.col(f"{c}.seq") > F.col("seq"), F.lit(False))
    has_landing, has_review = after("landing"), after("review")
    verdict = F.when(~has_review, "none").when(F.col("review.event_type") == "review.approved", "approved").otherwise("rejected")  # requested changes count as such
    landed = F.when(has_landing, F.when(F.col("landing.target") == "user", "accepted_user").otherwise("integrated_run")).otherwise("none")
    reverted, rejected = (F.coalesce(F.col("end.event_type") == k, F.lit(False)) for k in ("integration.reverted", "branch.rejected"))
    # The rungs that the evidence allows, from below; a record held back stays there.
    verified = (F.col("trust_state") == "verified") | ((F.col("memory_type") == "semantic") & has_landing & F.col("landing.commit_sha").isNotNull())
    approved = has_review & (verdict == "approved") & trust.independent(F.col("author_agent"), F.col("review.reviewer"))
    climbed = F.when(~verified | (F.col("trust_state") == "quarantined"), F.col("trust_state")).when(~approved | ((F.col("memory_type") == "procedural") & ~has_landing), "verified").when(has_landing & F.col("landing.commit_sha").isNotNull(), "integrated").otherwise("reviewed")
    own = F.coalesce(F.col("landing.task_id") == F.col("task_id"), F.lit(False)) | F.col("commit_sha").isNull()
    return rows.select(
        *(c for c in records.columns if c not in ("trust_state", "commit_sha")),
        F.when(rejected, "rejected").when(reverted, "invalidated").otherwise(climbed).alias("trust_state"),
        verdict.alias("review_state"),
        F.when(reverted, "reverted").otherwise(landed).alias("integration_state"),
        F.when(has_landing & own, F.coalesce("landing.commit_sha", "commit_sha")).otherwise(F.col("commit_sha")).alias("commit_sha"),
        F.col("end.recorded_at").alias("invalid_at"),
        F.col("end.seq").alias("invalid_seq"),
    )


def predecessors(facts: DataFrame) -> DataFrame:
    """Changed facts with the one they replace: the last earlier fact on their subject that says something else. ``memory_id, seq, project_id, subject_key, statement, changes``."""
    w = Window.partitionBy("project_id", "subject_key").orderBy("seq")
    # The last different statement before a row: what stood before the run of equal statements that the row belongs to.
    before = F.lag("statement").over(w)
    rows = facts.withColumn("turn", ~F.coalesce(before == F.col("statement"), F.lit(False))).withColumn("last_id", F.lag("memory_id").over(w))
    started = F.last(F.when(F.col("turn"), F.struct("last_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.where("subject_key <> ''").withColumn("supersedes_id", started["last_id"]).where("changes and supersedes_id is not null").select("memory_id", "supersedes_id")


def contradicted(facts: DataFrame) -> DataFrame:
    """Ids of the current facts on whose subject, in the same place, another current fact says something else."""
    same = ["project_id", "repository_id", "branch", "subject_key"]
    sets = facts.where("subject_key <> ''").groupBy(*same).agg((F.min("statement") < F.max("statement")).alias("split")).where("split")
    on = reduce(lambda a, b: a & b, (F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in same))
    return facts.alias("f").join(sets.alias("s"), on, "left_semi").select("f.memory_id")
