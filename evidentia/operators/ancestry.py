"""Ancestry of commits in few rounds: unbranched lines are followed by pointer doubling, forks and merges level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.sources.scratch import written

#: Doublings a table; 2 ** (2 * 20) steps are more than any history has.
DOUBLINGS, TABLES = 2, 20


def lines(edges: DataFrame) -> DataFrame:
    """``commit, top, steps``: the youngest commit of each commit's unbranched line, and how far above it lies.

    edges: distinct ``child, parent``. A line goes on where a commit has one parent and that parent has no other child, so that it is entered
    at its top alone and left at its lowest commit. Each commit points at a child, then at that one's goal, and so on: a line of n commits takes log2(n) joins, in
    which every pointer meets one row. Commits on a cycle without any branch share one line, its smallest name, at 0 steps.
    """
    sole = lambda c: edges.groupBy(c).count().where("count = 1").select(c)
    links = edges.join(sole("child"), "child", "left_semi").join(sole("parent"), "parent", "left_semi").select(F.col("parent").alias("commit"), "child")
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("commit")).distinct()
    linked = F.col("child").isNotNull()
    walk = nodes.join(links, "commit", "left").select("commit", F.coalesce("child", "commit").alias("top"), linked.cast("long").alias("steps"), linked.alias("open"), F.least("commit", "child").alias("low"))
    walk = written(walk, "lines")
    for _ in range(TABLES):
        if walk.where("open").isEmpty():
            break
        for _ in range(DOUBLINGS):
            goal = walk.select(F.col("commit").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("open").alias("on"), F.col("low").alias("least"))
            # Lines that have reached their top stay out of the join: their pointers would all meet there.
            moved = walk.where("open").join(goal, "top").select("commit", F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("open"), F.least("low", "least").alias("low"))
            walk = walk.where("not open").union(moved)
        walk = written(walk, "lines")
    return walk.select("commit", F.when(F.col("open"), F.col("low")).otherwise(F.col("top")).alias("top"), F.when(F.col("open"), 0).otherwise(F.col("steps")).alias("steps"))


def ancestors(commits: DataFrame, of: list[str], most: int = 100_000) -> DataFrame:
    """``of, commit``: the commits that stated ones descend from, themselves included, by edges ``(child, parent)``.

    Rounds grow with the logarithm of the longest line and with the forks and merges in sequence (``most`` of them at most), not with the commits. Edges
    without a child or parent say nothing, repeated ones count once, cycles end, and a commit without edges is its own only ancestor.
    """
    spark = commits.sparkSession
    edges = written(commits.select("child", "parent").where("child is not null and parent is not null").distinct(), "edges")
    line = lines(edges)
    starts = spark.createDataFrame([(c, c) for c in dict.fromkeys(of)], "of string, commit string")
    begun = starts.join(line, "commit").select("of", "top", F.col("steps").alias("from_step"))
    # Edges between lines leave the lowest commit of one and enter the top of another.
    at = lambda c: line.select(F.col("commit").alias(c), F.col("top").alias(f"{c}_top"), F.col("steps").alias(f"{c}_steps"))
    between = edges.join(at("child"), "child").join(at("parent"), "parent").where("child_top <> parent_top or parent_steps <= child_steps")
    between = written(between.select(F.col("child_top").alias("top"), F.col("parent_top").alias("next")).distinct(), "between")
    front = begun.select("of", "top")
    seen = spark.createDataFrame([], front.schema)
    for _ in range(most):
        front = written(front.join(between, "top").select("of", F.col("next").alias("top")).distinct().join(seen, ["of", "top"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = written(seen.union(front), "seen")
    else:
        raise ValueError("the history is deeper than the bound")
    own = begun.join(line, "top").where("steps >= from_step").select("of", "commit")
    return starts.union(own).union(seen.join(line, "top").select("of", "commit")).distinct()
