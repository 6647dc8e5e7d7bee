"""The stream of all projections against a rebuild over the whole journal, in any cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.operators import projections as PR
from evidentia.streaming import projection as P
from evidentia.streaming.folds import merged_fold, partial_fold

SHAPE = (
    "seq long, event_id string, event_type string, source string, project_id string, task_id string, branch string, command string, purpose string, statement string, agent_profile string, adapter string, "
    "commit_sha string, recorded_at timestamp_ntz, target string, reviewer string, ok boolean, signature string, error_kind string"
)
KINDS = ("verification.passed", "verification.failed", "attempt.completed", "review.approved", "review.rejected", "integration.landed", "integration.reverted", "branch.rejected", "fact.observed", "human.decision")


def journal(spark, n, seed):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    pick = lambda *xs: r.choice(xs)
    rows = [
        (i, f"e{i}", r.choice(KINDS[:6] + KINDS[8:] if r.random() < 0.9 else KINDS), pick("kernel", "human", "agent"), pick("p", "q"), pick(None, "t1", "t2", "t3"), pick(None, "dev", "main"), pick(None, "make", "pytest"), pick(None, "tests"), pick(None, "Port is 80", "Use uv"), pick("a", "b", None),
         pick("x", "y"), pick(None, "abc1234"), start + timedelta(minutes=i), pick("user", "run"), pick("a", "b"), pick(True, False, None), pick("s1", "s2"), "timeout")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SHAPE)


def rows_of(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


def streamed(spark, folder, projection=None):
    projection = projection or P.Projection(spark, f"{folder}/out")
    events = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    projection.start(events).awaitTermination()
    return projection


def check(projection, rows):
    assert rows_of(projection.lives()) == rows_of(PR.lives(PR.project(rows), rows))
    assert rows_of(projection.failures()) == rows_of(merged_fold(partial_fold(rows)))
    assert rows_of(projection.performance().drop("success_rate")) == rows_of(P.merged_performance(P.partial_performance(rows)))


def test_any_cut_equals_rebuild(spark, tmp_path):
    rows = journal(spark, 160, 1)
    # Late events first, some of them again in other batches, one batch without anything new.
    cuts = ("seq >= 100", "seq < 30 or seq > 150", "seq < 30")
    for i, cut in enumerate(cuts):
        rows.where(cut).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    projection = streamed(spark, tmp_path)
    check(projection, rows.where("seq < 30 or seq >= 100"))
    assert projection.compact() == 2
    rows.coalesce(1).write.parquet(str(tmp_path / "in/3"))
    projection = streamed(spark, tmp_path)
    check(projection, rows)  # merged folds and a later batch
    assert projection.compact() == 3 == projection.compact()
    check(streamed(spark, tmp_path), rows)  # nothing new


class Dies(P.Projection):
    def _mark(self, kind, number):
        if number == 1:
            raise RuntimeError("lost")
        super()._mark(kind, number)


def test_a_batch_that_dies_is_not_read_and_comes_again(spark, tmp_path):
    rows = journal(spark, 90, 2)
    for i in range(3):
        rows.where(F.col("seq") % 3 == i).union(rows.where("seq < 5")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    dying = Dies(spark, f"{tmp_path}/out")
    with pytest.raises(Exception, match="lost"):
        streamed(spark, tmp_path, dying)
    assert dying._last("done") == 0 and spark.read.parquet(f"{tmp_path}/out/records").select("batch").distinct().count() == 2
    first = dying.performance().agg(F.sum("verifications")).first()[0]
    projection = streamed(spark, tmp_path)
    check(projection, rows)
    assert projection.performance().agg(F.sum("verifications")).first()[0] > first


def test_nothing_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        P.Projection(spark, f"{tmp_path}/out").lives()
