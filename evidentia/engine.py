"""One project's memory in a shared folder: a journal in Parquet, and everything else derived from it by Spark jobs.

    engine = Engine(spark, "/shared/store", "my-project")
    engine.record_verification(command="pytest -q", passed=False, error_kind="timeout", task_id="t1")
    engine.recall("why does pytest time out").show()

Calls that record take one event or a DataFrame of events; a batch is published whole or not at all, and chained to the one before
(``sources.store``). Records are rebuilt from the journal when they are asked for, once for each head of the journal and kept in the folder until it
moves on, so that nothing derived can disagree with it; requests upon records (promote, reject, invalidate, supersede) are events too, and applied in
order (``operators.lifecycle``).
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import ranking, safety
from evidentia.functions import text as T
from evidentia.functions.records import redact_json, refusal
from evidentia.operators import digest, facts, lifecycle, preflight, projections, trust
from evidentia.operators import journal as J
from evidentia.operators import memory as M
from evidentia.sources import jsonl
from evidentia.sources.store import Store

FIELDS = (
    "event_id string, event_type string, source string, project_id string, repository_id string, task_id string, run_id string, attempt_id string, branch string, command string, error_kind string, error string,"
    " purpose string, statement string, resolves_signature string, target string, reviewer string, agent_profile string, adapter string, commit_sha string, ok boolean, recorded_at timestamp_ntz, payload string"
)

#: Columns of a stored event: what it says, and what is derived from that once.
STORED = FIELDS + ", content_hash string, signature string, subject_key string"
NAMES = [f.strip().split(" ")[0] for f in FIELDS.split(",")]
# Events that ask something of a record, and what.
REQUESTS = {"human.promotion": "promote", "human.rejection": "reject", "human.invalidation": "invalidate", "fact.changed": "supersede"}


def content_hash():
    """Of all that an event says, but not when: an event sent again is the same one."""
    return F.sha2(F.to_json(F.struct(*(c for c in NAMES if c != "recorded_at"))), 256)


def envelope_hash():
    return F.sha2(F.concat_ws("|", content_hash(), F.col("recorded_at").cast("string"), F.col("seq").cast("string"), "signature", "subject_key"), 256)


class Engine:
    """The calls of one project. Sources are fixed by the call: tools report outcomes, people decide, agents only propose."""

    def __init__(self, spark: SparkSession, folder: str, project_id: str, poison_threshold: float = safety.POISON_THRESHOLD) -> None:
        self.spark, self.folder, self.project_id, self.threshold = spark, folder.rstrip("/"), project_id, poison_threshold
        self.store = Store(spark, self.folder, STORED, envelope_hash)
        self._kept: tuple[str, DataFrame] | None = None  # records as of a head of the journal

    def journal(self) -> DataFrame:
        """All events of the project, with ``seq``, hashes and failure signature."""
        return self.store.read().where(F.col("project_id") == self.project_id)

    def record(self, events: DataFrame) -> DataFrame:
        """Appends events: redacted, checked, hashed and numbered. Known equal events are dropped; a conflict or refusal stops the batch."""
        # The journal's columns in order; what an event doesn't say is null.
        kinds = dict(f.strip().split(" ") for f in FIELDS.split(","))
        given = set(events.columns)
        rows = events.select(*(F.col(c).cast(k).alias(c) if c in given else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
        rows = rows.withColumn("project_id", F.coalesce("project_id", F.lit(self.project_id)))
        for c in ("command", "error", "purpose", "statement"):
            rows = rows.withColumn(c, safety.redact(F.col(c))["text"])
        rows = rows.withColumn("payload", redact_json(F.col("payload")))
        bad = rows.select(refusal(F.col("project_id"), F.coalesce("payload", F.lit("{}")), F.coalesce("statement", "error", F.lit(""))).alias("why")).where("why is not null").limit(1).collect()
        if bad:
            raise ValueError(f"event refused: {bad[0].why}")
        failed = F.col("event_type").isin(*("verification.failed", "command.failed", "agent.failure_report"))
        rows = rows.withColumn("content_hash", content_hash())
        rows = rows.withColumn("signature", F.when(failed, T.failure_signature(F.coalesce("command", F.lit("")), F.coalesce("error_kind", F.lit("")), T.fingerprint(F.coalesce("error", F.lit(""))))))
        rows = rows.withColumn("subject_key", T.subject_key(F.coalesce("statement", F.lit(""))))
        seen = self.store.commits()
        known = self.store.read(seen).select("event_id", F.col("content_hash").alias("payload_hash"))
        fresh = J.append_all(known, rows.withColumnRenamed("content_hash", "payload_hash")).withColumnRenamed("payload_hash", "content_hash")
        head = seen[-1]["last_seq"] if seen else 0
        numbered = M.positions(fresh, [F.asc("recorded_at"), F.asc("event_id")]).withColumn("seq", F.col("position") + head).drop("position")
        commit = self.store.append(numbered, seen)  # refused if another writer was faster
        return self.store.read([commit] if commit else [])

    def record_event(self, event_type: str, source: str = "kernel", **fields) -> str:
        """Appends one event and returns its id."""
        event = {"event_id": uuid.uuid4().hex, "recorded_at": datetime.now(timezone.utc).replace(tzinfo=None)} | fields | {"event_type": event_type, "source": source, "project_id": self.project_id}
        unknown = set(event) - set(NAMES)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        self.record(self.spark.createDataFrame([tuple(event.get(n) for n in NAMES)], FIELDS))
        return event["event_id"]

    def record_verification(self, command: str, passed: bool, **fields) -> str:
        return self.record_event("verification.passed" if passed else "verification.failed", command=command, **fields)

    def record_review(self, verdict: str, reviewer: str, **fields) -> str:
        return self.record_event(f"review.{verdict}", reviewer=reviewer, **fields)

    def record_decision(self, statement: str, **fields) -> str:
        return self.record_event("human.decision", "human", statement=statement, **fields)

    def record_fact(self, statement: str, changed: bool = False, **fields) -> str:
        return self.record_event("fact.changed" if changed else "fact.observed", statement=statement, **fields)

    def record_integration(self, commit_sha: str, target: str = "run", **fields) -> str:
        return self.record_event("integration.landed", commit_sha=commit_sha, target=target, **fields)

    def propose(self, statement: str, **fields) -> str:
        """An agent's observation: held back until evidence links it."""
        return self.record_event("agent.observation", "agent", statement=statement, **fields)

    def promote(self, memory_id: str, target: str, actor: str, source: str = "human", **fields) -> str:
        """Asks for the next rung; whether it is granted is up to the record's evidence: see ``refusals``."""
        return self._ask("human.promotion", source, {"memory_id": memory_id, "actor": actor}, target=target, **fields)

    def reject(self, memory_id: str, actor: str, reason: str = "", **fields) -> str:
        """Rejects a record for good; it is kept as an experience."""
        return self._ask("human.rejection", "human", {"memory_id": memory_id, "actor": actor, "reason": reason}, **fields)

    def invalidate(self, memory_id: str, actor: str = "", reason: str = "", **fields) -> str:
        """Marks a record as no longer true; newer evidence may bring it back."""
        return self._ask("human.invalidation", "human", {"memory_id": memory_id, "actor": actor, "reason": reason}, **fields)

    def supersede(self, memory_id: str, statement: str, **fields) -> str:
        """Replaces a fact by a newer one; both are kept."""
        return self._ask("fact.changed", "kernel", {"memory_id": memory_id}, statement=statement, **fields)

    def _ask(self, kind: str, source: str, payload: dict, **fields) -> str:
        return self.record_event(kind, source, payload=json.dumps(payload), **fields)

    def reject_branch(self, branch: str, **fields) -> str:
        return self.record_event("branch.rejected", "human", branch=branch, **fields)

    def events(self, spec: J.EventFilter | None = None) -> DataFrame:
        return (spec or J.EventFilter(self.project_id)).apply(self.journal())

    def failures(self) -> DataFrame:
        rows = self.journal()
        return J.failure_fold(rows).join(J.resolutions(rows), ["project_id", "signature"], "left")

    def _evidenced(self, rows: DataFrame) -> DataFrame:
        """Every record as events alone have left it, with its evidence; failures as one record a signature."""
        live = self._replaced(projections.lives(projections.project(rows), rows), rows)
        said = T.repeated_text(T.gotcha_text(F.coalesce("command", F.lit("")), F.coalesce("error_kind", F.lit("")), F.lit(""), F.coalesce("branch", F.lit(""))), F.col("occurrences"))
        failed = J.failure_fold(rows).join(rows.select("event_id", "source", "agent_profile", "commit_sha"), F.col("first_event_id") == F.col("event_id"))
        trusted = F.col("source").isin(*trust.TRUSTED_SOURCES)
        nothing = F.lit(None).cast("string")
        gotchas = failed.select(
            F.concat_ws(":", "signature", F.lit("gotcha")).alias("memory_id"), F.col("first_seq").alias("seq"), "event_id", "project_id", "task_id", "branch", F.col("agent_profile").alias("author_agent"), F.col("first_seen").alias("recorded_at"),
            F.lit("gotcha").alias("memory_type"), said.alias("text"), F.lit("failed").alias("verification_state"), T.subject_key(F.coalesce("command", F.lit(""))).alias("subject_key"), F.when(trusted, "verified").otherwise("quarantined").alias("trust_state"),
            F.lit("none").alias("review_state"), F.lit("none").alias("integration_state"), "commit_sha", F.lit(None).cast("timestamp_ntz").alias("invalid_at"),
        )
        live = live.unionByName(gotchas.select(live.columns)).join(rows.select("event_id", "command"), "event_id", "left").withColumn("source_event_ids", F.array("event_id"))
        matches = safety.poison_matches(F.col("text"))
        live = live.withColumn("poisoning_matches", matches).withColumn("poisoning_risk", safety.poison_risk(F.col("poisoning_matches")))
        held = F.when((F.col("poisoning_risk") >= self.threshold) & ~F.col("trust_state").isin(*ranking.TERMINAL), "quarantined").otherwise(F.col("trust_state"))
        return trust.with_evidence(live.withColumn("trust_state", held), rows.withColumn("linked", F.lit(True)))

    def _replaced(self, live: DataFrame, rows: DataFrame) -> DataFrame:
        """Records after the facts that changed: the newest current fact on a changed fact's subject that said something else is superseded.

        A change that names the record it replaces (``supersede``) is a request upon that record, which ends there for newer facts.
        """
        target = F.get_json_object("payload", "$.memory_id")
        changed = rows.where("event_type = 'fact.changed'")
        named = changed.where(target.isNotNull() & F.col("source").isin(*lifecycle.WITHDRAWAL_SOURCES)).groupBy(target.alias("memory_id")).agg(F.min("seq").alias("_named"))
        said = live.where("memory_type = 'semantic'").join(changed.where(target.isNull()).select("event_id", F.lit(True).alias("changes")), "event_id", "left").join(named, "memory_id", "left")
        nothing = F.lit(None).cast("string")
        facts_ = said.select("memory_id", "seq", "project_id", nothing.alias("repository_id"), "branch", "subject_key", F.col("text").alias("statement"), "changes", F.least("invalid_seq", "_named").alias("until"))
        gone = facts.superseded(facts.arrivals(facts_)).join(rows.select(F.col("seq").alias("superseded_at"), F.col("recorded_at").alias("_at")), "superseded_at").select("memory_id", "_at")
        ended = F.col("_at").isNotNull()
        out = live.join(gone, "memory_id", "left").withColumns({"trust_state": F.when(ended, "superseded").otherwise(F.col("trust_state")), "invalid_at": F.when(ended, F.col("_at")).otherwise(F.col("invalid_at"))})
        return out.select(live.columns).drop("invalid_seq")

    def contradictions(self) -> DataFrame:
        """Contradictions that are still open between the project's facts: ``project_id, subject_key, memory_id_a, memory_id_b, seq``."""
        now = self.memories().where("memory_type = 'semantic'").select("memory_id", "seq", "project_id", F.lit(None).cast("string").alias("repository_id"), "branch", "subject_key", F.col("text").alias("statement"), F.lit(False).alias("changes"), F.when(F.col("trust_state").isin(*ranking.TERMINAL), F.col("seq")).alias("until"))
        # A change replaces; only an observed fact contradicts what it meets.
        changed = self.journal().where("event_type = 'fact.changed'").select(F.concat_ws(":", "event_id", F.lit("semantic")).alias("memory_id"))
        return facts.open_contradictions(now, facts.arrivals(now).join(changed, "memory_id", "left_anti"))

    def _told(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The events, the records as events have left them, and what became of the requests upon them."""
        seen = self.store.commits()
        rows = self.store.read(seen).where(F.col("project_id") == self.project_id)
        head = seen[-1]["head"] if seen else ""
        if self._kept is None or self._kept[0] != head:
            path = f"{self.folder}/projections/{uuid.uuid4().hex}"
            records = self._evidenced(rows)
            records.write.parquet(path)
            self._kept = head, self.spark.read.schema(records.schema).parquet(path)
        return rows, self._kept[1], self._history(rows, self._kept[1])

    def drop_projections(self) -> None:
        """Forgets all derived records; the next call derives them anew."""
        self._kept = None
        self.store.delete("projections")

    def _history(self, rows: DataFrame, records: DataFrame) -> DataFrame:
        kinds = F.create_map(*(F.lit(x) for pair in REQUESTS.items() for x in pair))
        asked = rows.withColumns({"memory_id": F.get_json_object("payload", "$.memory_id"), "action": F.try_element_at(kinds, F.col("event_type"))}).where("action is not null and memory_id is not null")
        return lifecycle.history(records, asked, self.threshold)

    def history(self) -> DataFrame:
        """What became of every request upon a record, in order: transitions and refusals with their rules."""
        return self._told()[2].orderBy("seq")

    def transitions(self) -> DataFrame:
        return lifecycle.transitions(self.history())

    def refusals(self) -> DataFrame:
        return lifecycle.refusals(self.history())

    def memories(self) -> DataFrame:
        """Every record of the project with its present state and poisoning risk."""
        _, records, told = self._told()
        live = lifecycle.applied(records, told).drop("evidence", "command")
        age = F.floor((F.unix_micros(F.current_timestamp()) - F.unix_micros(F.col("recorded_at").cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
        return live.withColumn("scope_level", F.when(F.col("branch").isNull(), "repository").otherwise("branch")).withColumns(
            {"repository_id": F.lit(None).cast("string"), "run_id": F.lit(None).cast("string"), "access_count": F.lit(0).cast("long"), "age_days": F.greatest(age, F.lit(0))}
        )

    rebuild = memories

    def recall(self, query: str, limit: int = 20, min_trust: int = 2, **more) -> DataFrame:
        return M.recall(self.memories(), query, self.project_id, min_trust, min(max(limit, 1), 200), **more)

    def digest(self, query: str, budget: int = 4000, **more) -> digest.Digest:
        rows = self.memories()
        truth = F.col("trust_state").isin("integrated") | (F.col("memory_type") != "semantic")
        said = ranking.warnings(truth, F.col("applicability"), F.lit(False), F.lit(True), F.size("poisoning_matches"))
        landed = F.col("integration_state").isin("integrated_run", "accepted_user")
        proof = T.provenance_line(F.col("verification_state"), F.lit(None).cast("string"), F.col("review_state"), landed, F.col("commit_sha"), F.lit(1))
        found = self.recall(query, **more).select("memory_id", "applicability", "rank")
        lines = rows.join(found, "memory_id").select("memory_id", "memory_type", "text", T.trust_label(F.col("trust_state")).alias("label"), proof.alias("provenance"), said.alias("warnings"), "rank")
        return digest.compose(lines.orderBy("rank"), budget)

    def explain(self, memory_id: str) -> DataFrame:
        """What the journal holds of the events that a record cites."""
        return M.provenance(self.memories().where(F.col("memory_id") == memory_id), self.journal())

    def preflight(self, proposals: DataFrame) -> DataFrame:
        failures = self.failures().select("project_id", F.col("signature").alias("memory_id"), "signature", "command", "occurrences", F.lit("current").alias("applicability"))
        decisions = self.journal().where("event_type = 'human.decision'").select("project_id", F.col("event_id").alias("memory_id"), F.explode(F.from_json(F.get_json_object("payload", "$.rejected"), "array<string>")).alias("alternative"))
        return preflight.matches(proposals, failures, decisions)

    def status(self) -> DataFrame:
        return J.project_heads(self.journal())

    def audit(self) -> DataFrame:
        """Where the stored journal no longer agrees with the hashes that were stored with it: ``batch, problem, n``; no rows if it does."""
        return self.store.audit()

    def export(self, path: str) -> None:
        jsonl.export(jsonl.encoded(self.journal(), "event", "event_id", "project_id", event_type="event_type", command="command", statement="statement", payload="payload"), path)

    def compare_import(self, path: str) -> DataFrame:
        """Lines of a folder against the journal: new, duplicate or conflict; what is wrong with a line stops nothing."""
        lines = jsonl.encoded(self.journal(), "event", "event_id", "project_id", event_type="event_type", command="command", statement="statement", payload="payload")
        known = lines.select("id", F.get_json_object("value", "$.hash").alias("hash"))
        return jsonl.decoded(jsonl.compared(jsonl.read(self.spark, path, self.project_id)[0], known))


def register(spark: SparkSession) -> None:
    """Names for SQL: ``normalize_error``, ``normalize_command`` and ``failure_shape`` as temporary functions of built-in expressions."""

    def nested(rules) -> str:
        out = "text"
        for pattern, to in rules:
            said = (T.UNICODE + pattern).replace("\\", "\\\\").replace("'", "\\'")
            out = f"regexp_replace({out}, '{said}', '{to}')"
        return out

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_error(text STRING) RETURNS STRING RETURN lower(trim({nested(T.ERROR_RULES)}))")
    # The same two steps as ``normalize_command``.
    steps = "trim(regexp_replace(regexp_replace(text, '/(?:private/)?(?:tmp|var/folders)/[^\\\\s]*', '<TMP>'), '\\\\s+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_command(text STRING) RETURNS STRING RETURN {steps}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION failure_shape(command STRING, kind STRING, text STRING) RETURNS STRING RETURN concat('cmd=', trim(command), '\\nkind=', kind, '\\nerr=', normalize_error(text))")
