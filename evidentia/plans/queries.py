"""Queries over the driver tables, each with SQL of the same rows for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import STOPWORDS, normalize_command, subject_key
from evidentia.operators import journal as J
from evidentia.operators import memory as M
from evidentia.sources.driver_tables import journal, memories, table
from evidentia.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

JOURNAL = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
j AS (SELECT event_id AS seq, event_id, ts AS recorded_at, 'p' || (user_id % 5) AS project_id, 'agent-' || user_id AS agent_profile,
  'task-' || ((user_id * 7 + k) % 50) AS task_id, 'cmd-' || (k % 20) AS command,
  CASE k % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'assertion' ELSE 'import' END AS error_kind,
  CASE event_type WHEN 'error' THEN 'verification.failed' WHEN 'purchase' THEN 'verification.passed' WHEN 'signup' THEN 'attempt.completed'
    WHEN 'click' THEN 'review.approved' ELSE 'fact.observed' END AS event_type,
  CASE user_id % 10 WHEN 0 THEN 'agent' WHEN 1 THEN 'import' WHEN 2 THEN 'human' ELSE 'kernel' END AS source, 'run-' || (user_id % 11) AS run_id,
  CASE WHEN k % 4 < 3 THEN 'b-' || (k % 4) END AS branch, CASE WHEN k % 6 < 5 THEN 'goal-' || (k % 6) END AS purpose, 'adapter-' || (user_id % 2) AS adapter,
  CASE WHEN event_id % 5 = 0 THEN substr(sha256(CAST(event_id AS VARCHAR)), 1, 12) END AS commit_sha,
  CASE WHEN event_type = 'purchase' AND event_id % 40 < 8 THEN 'sha256:' || sha256('cmd=cmd-' || ((k + 7) % 20) || chr(10) || 'kind=timeout' || chr(10) || 'err=') END AS resolves_signature,
  's-' || k AS subject_key, CAST(floor(value / 50) AS BIGINT) AS statement, value < 150 AS ok,
  'sha256:' || sha256('cmd=cmd-' || (k % 20) || chr(10) || 'kind=' || CASE k % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'assertion' ELSE 'import' END || chr(10) || 'err=') AS signature
  FROM e)
"""
MEMORIES = """
m0 AS (SELECT d.doc_id AS memory_id, d.doc_id AS i, d.text, d.lang AS project_id, CASE WHEN d.doc_id % 11 <> 0 THEN d.source END AS branch,
  CASE d.doc_id % 6 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' WHEN 3 THEN 'decision' WHEN 4 THEN 'gotcha' ELSE 'performance' END AS memory_type,
  CASE WHEN toxic = 1 THEN 'quarantined' WHEN quality = 0 THEN 'rejected' WHEN quality = 1 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'integrated' ELSE 'verified' END ELSE 'observed' END AS trust_state,
  CASE WHEN toxic = 1 THEN 0.6 ELSE 0.0 END AS poisoning_risk, d.doc_id % 97 AS age_days, d.doc_id % 53 AS access_count,
  TIMESTAMP '2024-06-01' - to_days(CAST(d.doc_id % 97 AS INTEGER)) AS recorded_at
  FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT *, CASE i % 7 WHEN 0 THEN 'project' WHEN 1 THEN 'repository' ELSE 'branch' END AS scope_level, CASE WHEN i % 4 < 3 THEN 'repo-' || (i % 4) END AS repository_id,
  'run-' || (i % 13) AS run_id, 'task-' || (i % 50) AS task_id, 'agent-' || (i % 9) AS author_agent, 'cmd-' || (i % 20) AS command, CASE WHEN i % 5 = 0 THEN 'c' || (i % 40) END AS commit_sha,
  CASE WHEN i % 17 = 0 THEN recorded_at + INTERVAL 3 DAY END AS invalid_at, CASE i % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'unknown' END AS verification_state,
  CASE i % 5 WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'none' END AS review_state,
  CASE WHEN trust_state = 'integrated' THEN CASE i % 2 WHEN 0 THEN 'accepted_user' ELSE 'integrated_run' END ELSE 'none' END AS integration_state,
  CASE WHEN i % 10 IN (1, 2, 3) THEN i - 1 WHEN i % 10 = 4 THEN i - 2 WHEN i % 50 = 7 THEN -i END AS supersedes_id, [i, i * 11 + 5] AS source_event_ids FROM m0),
r AS (SELECT *, CASE trust_state WHEN 'quarantined' THEN 1 WHEN 'observed' THEN 2 WHEN 'verified' THEN 3 WHEN 'reviewed' THEN 4 WHEN 'integrated' THEN 5 ELSE 0 END AS trust_rank FROM m)
"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


FOLD = """f AS (SELECT project_id, signature, arg_min(event_id, seq) AS first_event_id, arg_min(command, seq) AS command, arg_min(error_kind, seq) AS error_kind, count(*) AS occurrences,
  min(recorded_at) AS first_seen, max(recorded_at) AS last_seen, min(seq) AS first_seq FROM j WHERE event_type = 'verification.failed' GROUP BY ALL)"""
RESOLVED = """
g AS (SELECT f.*, j.task_id, j.purpose FROM f JOIN j ON j.seq = f.first_seq),
y AS (SELECT g.project_id, g.signature, min(p.seq) AS resolved_by_event, arg_min(p.recorded_at, p.seq) AS resolved_at FROM g JOIN j p
  ON p.event_type = 'verification.passed' AND g.project_id = p.project_id AND p.seq > g.first_seq
  AND CASE WHEN p.resolves_signature IS NOT NULL THEN p.resolves_signature = g.signature ELSE g.task_id = p.task_id AND (g.command = p.command OR g.purpose = p.purpose) END GROUP BY ALL)
"""


@query(f"""WITH {JOURNAL}, {FOLD}, {RESOLVED}
SELECT f.project_id, f.signature, command, occurrences, first_seen, last_seen, resolved_by_event,
  CAST(floor((epoch_us(resolved_at) - epoch_us(first_seen)) / 60000000.0) AS BIGINT) AS minutes_to_fix
FROM f LEFT JOIN y ON f.project_id = y.project_id AND f.signature = y.signature WHERE occurrences >= 2""")
def repeat_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.repeat_failures(journal(spark, sf_dir))


@query(f"WITH {JOURNAL} SELECT project_id, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq, min(recorded_at) AS created_at FROM j GROUP BY project_id")
def project_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.project_heads(journal(spark, sf_dir))


@query(f"""WITH {JOURNAL} SELECT seq, event_type, task_id, agent_profile, recorded_at FROM j WHERE project_id = 'p1' AND event_type IN ('verification.failed', 'verification.passed')
AND recorded_at >= TIMESTAMP '2024-01-05 00:00:00' AND recorded_at <= TIMESTAMP '2024-01-20 00:00:00'""")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = J.EventFilter("p1", ("verification.failed", "verification.passed"), since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
    return spec.apply(journal(spark, sf_dir)).select("seq", "event_type", "task_id", "agent_profile", "recorded_at")


@query(f"WITH {JOURNAL} SELECT seq, event_type FROM j WHERE project_id = 'p2' ORDER BY seq DESC LIMIT 50 OFFSET 10")
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.EventFilter("p2", limit=50, offset=10, descending=True).apply(journal(spark, sf_dir)).select("seq", "event_type")


@query(f"WITH {JOURNAL}, {FOLD} SELECT * FROM f")
def failure_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.failure_fold(journal(spark, sf_dir)).drop("task_id", "run_id", "purpose", "branch")


@query(f"WITH {JOURNAL} SELECT seq, project_id, signature, CAST(row_number() OVER (PARTITION BY project_id, signature ORDER BY seq) AS INTEGER) AS occurrence FROM j WHERE event_type = 'verification.failed'")
def failure_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.occurrences(journal(spark, sf_dir))


@query(f"WITH {JOURNAL}, {FOLD}, {RESOLVED} SELECT project_id, signature, resolved_by_event, resolved_at FROM y")
def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.resolutions(journal(spark, sf_dir))


@query(f"""WITH {JOURNAL}, a AS (SELECT project_id, agent_profile, adapter, sha256(array_to_string(list_sort(list(DISTINCT event_id)), ',')) AS event_ids_sha256, count(*) FILTER (event_type = 'attempt.completed') AS attempts,
  count(*) FILTER (event_type = 'attempt.completed' AND ok) AS successes, count(*) FILTER (event_type LIKE 'verification.%') AS verifications,
  count(*) FILTER (event_type = 'review.approved') AS approvals, min(recorded_at) AS first_seen, max(recorded_at) AS last_seen
  FROM j WHERE event_type <> 'fact.observed' GROUP BY ALL)
SELECT *, CASE WHEN attempts > 0 THEN round_even(successes / attempts, 4) END AS success_rate FROM a""")
def agent_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.performance(journal(spark, sf_dir))


@query(f"""WITH {JOURNAL}, t AS (SELECT project_id, branch, subject_key, statement, min(seq) AS seq FROM j WHERE event_type = 'fact.observed' GROUP BY ALL),
w AS (SELECT *, min(seq) OVER s AS first_seq, count(*) OVER s AS statements FROM t WINDOW s AS (PARTITION BY project_id, branch, subject_key))
SELECT * FROM w WHERE statements > 1""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.contradictions(journal(spark, sf_dir))


@query(f"WITH {JOURNAL} SELECT project_id, subject_key, arg_max(statement, seq) AS statement, max(seq) AS seq FROM j WHERE event_type = 'fact.observed' GROUP BY ALL")
def latest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_facts(journal(spark, sf_dir))


@query(f"WITH {JOURNAL} SELECT project_id, task_id, count(*) AS n_reviews, arg_max(agent_profile, seq) AS last_reviewer FROM j WHERE event_type = 'review.approved' GROUP BY ALL")
def last_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.last_reviews(journal(spark, sf_dir))


@query(f"WITH {JOURNAL} SELECT project_id, event_type, subject_key, statement, count(*) AS n FROM j GROUP BY ALL HAVING count(*) > 1")
def duplicate_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.duplicate_payloads(journal(spark, sf_dir))


@query(f"""WITH {JOURNAL}, p AS (SELECT project_id, seq // 65536 AS segment, seq, sha256(concat_ws('|', event_id, event_type, task_id, command, statement)) AS h FROM j),
s AS (SELECT project_id, segment, count(*) AS n, list_reduce(list_prepend('', list(h ORDER BY seq, h)), lambda a, x: sha256(a || '|' || x)) AS last FROM p GROUP BY ALL),
t AS (SELECT project_id, sum(n) AS n, list_reduce(list_prepend('', list(segment || '|' || n || '|' || last ORDER BY segment)), lambda a, x: sha256(a || '|' || x)) AS head FROM s GROUP BY ALL)
SELECT project_id, CAST(n AS BIGINT) AS n, CAST(0 AS BIGINT) AS broken, head FROM t""")
def chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = written(J.chained(journal(spark, sf_dir)), "chain")
    heads = written(J.segment_heads(chain), "heads")
    last = heads.groupBy("project_id").agg(F.max_by("head", "segment").alias("head"))
    return J.audit(chain, heads).join(last, "project_id")


@query("""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, median(value) AS median, max(value) FILTER (r = round_even(0.95 * (n - 1), 0)) AS p95, max(value) AS max FROM x GROUP BY event_type""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.nearest_rank(table(spark, sf_dir, "events"), "value", "event_type")


@query(f"""WITH {JOURNAL} SELECT project_id, event_type, count(*) AS n, CAST(grouping(project_id, event_type) AS BIGINT) AS level FROM j GROUP BY CUBE (project_id, event_type)""")
def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).cube("project_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@query(f"WITH {JOURNAL} SELECT project_id, time_bucket(INTERVAL '6 hours', recorded_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM j GROUP BY ALL")
def six_hour_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir).groupBy("project_id", F.window("recorded_at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("project_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


SCOPE_TEXT = """scope_level || '(' || array_to_string(list_filter([('project=' || project_id), ('repo=' || repository_id), ('branch=' || branch), ('run=' || run_id), ('task=' || task_id), ('agent=' || author_agent)], lambda x: x IS NOT NULL), ', ') || ')'"""


@query(f"""WITH {MEMORIES}, w AS (SELECT memory_id, CASE WHEN project_id <> 'en' THEN 'project' WHEN trust_state IN ('invalidated', 'superseded', 'rejected') THEN 'terminal'
  WHEN trust_rank < 3 THEN 'trust' WHEN invalid_at IS NOT NULL THEN 'current' WHEN contains({SCOPE_TEXT}, 'branch=src1') THEN 'scope' END AS reason FROM r)
SELECT memory_id, coalesce(reason, '') AS reason, CASE reason WHEN 'project' THEN '' WHEN 'terminal' THEN 'project' WHEN 'trust' THEN 'project,terminal' WHEN 'current' THEN 'project,terminal,trust'
  WHEN 'scope' THEN 'project,terminal,trust,current' ELSE 'project,terminal,trust,current,scope' END AS passed FROM w""")
def governance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"project_id": "en", "min_trust": 3, "exclude_scope": "branch=src1"}
    return memories(spark, sf_dir).select("memory_id", F.coalesce(M.reject_reason(**rules), F.lit("")).alias("reason"), F.array_join(M.passed_rules(**rules), ",").alias("passed"))


@query(f"WITH {MEMORIES} SELECT project_id, memory_type, trust_state, count(*) AS n FROM m GROUP BY ALL")
def memories_by_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("project_id", "memory_type", "trust_state").agg(F.count(F.lit(1)).alias("n"))


SPECIFIC = """CASE WHEN project_id <> 'en' THEN 'f' WHEN scope_level = 'project' THEN 'p' WHEN repository_id <> 'repo-1' THEN 'f' WHEN scope_level = 'repository' THEN 'r' WHEN branch IS NULL THEN 'u' WHEN branch = 'src3' THEN 'b' ELSE 'f' END"""


@query(f"""WITH {MEMORIES}, x AS (SELECT *, {SPECIFIC} AS c FROM m)
SELECT memory_id, CAST(CASE c WHEN 'f' THEN 0.3 WHEN 'p' THEN 0.6 WHEN 'b' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS specificity, CASE c WHEN 'f' THEN 'cross' WHEN 'u' THEN 'uncertain' ELSE 'current' END AS applicability, {SCOPE_TEXT} AS scope FROM x""")
def scope_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, label = M.specificity("src3", "repo-1", "en")
    return memories(spark, sf_dir).select("memory_id", value.alias("specificity"), label.alias("applicability"), M.described_scope().alias("scope"))


@query(f"WITH {MEMORIES} SELECT memory_type, sha256(text) AS text_sha256, min(memory_id) AS memory_id, count(*) AS copies FROM m GROUP BY ALL")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.keep_first(memories(spark, sf_dir))


QUERY = "thing AND the reand ontion of eresnd"
TERMS = ["thing", "reand", "ontion", "eresnd"]


@query(f"""WITH {MEMORIES}, t AS (SELECT memory_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM m),
c AS (SELECT memory_id, len(w) AS length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (SELECT unnest({TERMS!r}) AS term)),
s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
n AS (SELECT term, count(*) FILTER (tf > 0) AS n FROM c GROUP BY term),
h AS (SELECT memory_id, sum((CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS raw, max(tf) AS best
  FROM c JOIN n USING (term), s GROUP BY memory_id),
k AS (SELECT memory_id, raw FROM h JOIN m USING (memory_id) WHERE best > 0 AND project_id = 'en' ORDER BY round_even(raw, 9) DESC, memory_id LIMIT 500),
l AS (SELECT memory_id, CASE WHEN (max(raw) OVER ()) - (min(raw) OVER ()) < 1e-12 THEN 1.0 ELSE (raw - min(raw) OVER ()) / ((max(raw) OVER ()) - (min(raw) OVER ())) END AS lexical FROM k),
q AS (SELECT *, CASE WHEN scope_level = 'project' THEN 'p' WHEN scope_level = 'repository' THEN 'r' WHEN branch IS NULL THEN 'u' WHEN branch = 'src3' THEN 'b' ELSE 'f' END AS c FROM r),
z AS (SELECT memory_id, memory_type, trust_state, recorded_at, CASE c WHEN 'f' THEN 'cross' WHEN 'u' THEN 'uncertain' ELSE 'current' END AS applicability, round_even(lexical + 0.5 * trust_rank / 5
  + 0.3 * ((CASE WHEN verification_state <> 'unknown' THEN 0.4 ELSE 0 END) + (CASE WHEN review_state = 'approved' THEN 0.3 ELSE 0 END) + (CASE WHEN integration_state <> 'none' THEN 0.3 ELSE 0 END))
  + 0.25 * pow(0.5, age_days / (CASE memory_type WHEN 'episodic' THEN 14 WHEN 'performance' THEN 30 WHEN 'semantic' THEN 60 WHEN 'gotcha' THEN 90 WHEN 'procedural' THEN 180 ELSE 365 END))
  + 0.15 * least(1.0, ln(1 + access_count) / ln(51)) + 0.2 * (CASE WHEN memory_type IN ('gotcha', 'decision') THEN 1.0 ELSE 0.5 END) + 0.3 * (CASE c WHEN 'f' THEN 0.3 WHEN 'p' THEN 0.6 WHEN 'b' THEN 1.0 ELSE 0.8 END)
  - 0.4 * (CASE WHEN memory_id % 9 = 0 THEN 1 ELSE 0 END) - 0.6 * poisoning_risk, 6) AS score
  FROM q JOIN l USING (memory_id) WHERE trust_rank >= 2 AND invalid_at IS NULL)
SELECT memory_id, memory_type, trust_state, applicability, round_even(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, recorded_at DESC, memory_id) AS INTEGER) AS rank FROM z ORDER BY rank LIMIT 20""")
def recall_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    contested = rows.where("memory_id % 9 = 0").select("memory_id")
    return M.recall(rows, QUERY, "en", branch="src3", wanted=("gotcha", "decision"), contested=contested)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS t FROM v WHERE vec_id = 0),
s AS (SELECT vec_id, list_cosine_similarity(e, t) AS c FROM v, q WHERE vec_id <> 0)
SELECT vec_id, round(c, 6) AS similarity FROM s ORDER BY round(c, 9) DESC, vec_id LIMIT 10""")
def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 0").select(F.col("embedding").alias("asked"))  # one row
    found = rows.where("vec_id <> 0").crossJoin(F.broadcast(asked)).select("vec_id", M.cosine(F.col("embedding"), F.col("asked")).alias("c"))
    return found.orderBy(F.desc(F.round("c", 9)), "vec_id").limit(10).select("vec_id", F.round("c", 6).alias("similarity"))


@query("""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS p FROM embeddings),
b AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS p FROM embeddings WHERE label < 5)
SELECT vec_id AS id, round(sum(1.0 / (60 + p)), 9) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")

    def ranking(i: int, some: DataFrame) -> DataFrame:
        keyed = some.select(F.lit(i).alias("list"), F.col("vec_id").alias("id"), F.col("embedding")[i].alias("x"))
        return M.positions(keyed, [F.desc("x"), F.asc("id")]).select("list", "id", "position")

    return M.fused(ranking(0, rows).union(ranking(1, rows.where("label < 5")))).select("id", F.round("fused", 9).alias("fused"))


STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({STOP})) AS a FROM documents),
b AS (SELECT doc_id, CASE WHEN len(list_filter(a, lambda x: length(x) > 2)) > 0 THEN list_filter(a, lambda x: length(x) > 2) ELSE a END AS c FROM w)
SELECT doc_id, array_to_string(list_sort(list_distinct(c[1:24]))[1:8], ' ') AS subject_key FROM b""")
def subject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", subject_key("text").alias("subject_key"))


@query(r"""SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(text, '/(?:private/)?(?:tmp|var/folders)/[^\s]*', '<TMP>', 'g'), '\s+', ' ', 'g'))) AS command_sha256 FROM conversations""")
def normalized_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(normalize_command("text"), 256).alias("command_sha256"))


@query(f"""WITH {JOURNAL}, f AS (SELECT DISTINCT project_id, task_id FROM j WHERE event_type = 'verification.failed'), p AS (SELECT DISTINCT project_id, task_id FROM j WHERE event_type = 'verification.passed')
SELECT project_id, task_id, 'unresolved' AS state FROM (SELECT * FROM f EXCEPT SELECT * FROM p) UNION ALL SELECT project_id, task_id, 'resolved' FROM (SELECT * FROM f INTERSECT SELECT * FROM p)""")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = journal(spark, sf_dir)
    failed, passed = (rows.where(F.col("event_type") == f"verification.{k}").select("project_id", "task_id") for k in ("failed", "passed"))
    return failed.subtract(passed).withColumn("state", F.lit("unresolved")).union(failed.intersect(passed).withColumn("state", F.lit("resolved")))
