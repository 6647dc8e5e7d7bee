"""Prior failures that resemble a proposed action, for a table of proposals at once.

Proposals are rows ``(proposal_id, project_id, command, error_kind, error_text, subsystem)``. Four tiers are unioned and the first
that finds a record wins. Signature and command are equi-joins. Whole-word tests join on the words of the shorter side first, so
that no tier compares every proposal with every record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import failure_signature, fingerprint, normalize_command, words

# Confidence of the tiers, what is reported at least, and what blocks.
CONFIDENCE = {"signature": 1.0, "command": 0.85, "alternative": 0.75, "overlap": 0.55}
LEAST, BLOCK_CONFIDENCE, BLOCK_OCCURRENCES = 0.40, 1.0, 2
FACTOR = {"uncertain": 0.8, "historical": 0.6}


def matches(proposals: DataFrame, failures: DataFrame, decisions: DataFrame, limit: int = 5) -> DataFrame:
    """``proposal_id, memory_id, tier, confidence, occurrences, rank, blocks``, the ``limit`` best of each proposal.

    failures: ``project_id, memory_id, signature, command, occurrences, applicability``; decisions: ``project_id, memory_id, alternative``.
    """
    named = F.coalesce(F.trim("command"), F.lit("")) != ""
    asked = proposals.withColumn("signature", failure_signature("command", "error_kind", fingerprint("error_text")))
    first = asked.where(named).join(failures.drop("command"), ["project_id", "signature"])
    second = asked.where(named).drop("signature").withColumn("shape", normalize_command("command")).join(failures.drop("signature").withColumn("shape", normalize_command("command")).drop("command"), ["project_id", "shape"])

    third = _alternatives(proposals.withColumn("text", F.lower(F.concat_ws(" ", "command", "subsystem"))), decisions)
    # A subsystem's words stand side by side in a failure's command.
    parts = proposals.withColumn("part", words(F.col("subsystem"))).where(F.length(F.trim("part")) >= 2)
    parts = parts.withColumn("word", F.split_part(F.trim("part"), F.lit(" "), F.lit(1)))
    known = failures.withColumn("known", words(F.col("command"))).withColumn("word", F.explode(F.array_distinct(F.split(F.trim("known"), " "))))
    fourth = parts.join(known.drop("command", "signature"), ["project_id", "word"]).where(F.contains("known", "part"))

    def tier(rows: DataFrame, name: str, order: int) -> DataFrame:
        return rows.select("proposal_id", "memory_id", F.lit(name).alias("tier"), F.lit(order).alias("order"), "occurrences", "applicability")

    found = tier(first, "signature", 1).union(tier(second, "command", 2)).union(tier(third, "alternative", 3)).union(tier(fourth, "overlap", 4))
    best = found.groupBy("proposal_id", "memory_id").agg(F.min(F.struct("order", "tier", "occurrences", "applicability")).alias("m")).select("proposal_id", "memory_id", "m.*")
    base = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        base = F.when(F.col("tier") == name, value).otherwise(base)
    factor = F.when(F.col("applicability") == "uncertain", FACTOR["uncertain"]).when(F.col("applicability") == "historical", FACTOR["historical"]).otherwise(1.0)
    best = best.withColumn("confidence", F.bround(base * factor, 4)).where(F.col("confidence") >= LEAST)
    w = Window.partitionBy("proposal_id").orderBy(F.desc("confidence"), F.desc("occurrences"), "memory_id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    blocks = (F.col("confidence") >= BLOCK_CONFIDENCE) & (F.col("occurrences") >= BLOCK_OCCURRENCES) & (F.col("applicability") == "current")
    return best.select("proposal_id", "memory_id", "tier", "confidence", "occurrences", "rank", blocks.alias("blocks"))


def _alternatives(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals whose text contains an alternative that a decision rejected, found by the three-letter gram they must share."""
    gram = 3
    offers = proposals.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - gram + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(gram))))))
    asked = decisions.withColumn("alternative", F.lower("alternative")).where(F.length("alternative") >= 1).distinct()
    asked = asked.withColumn("gram", F.substring("alternative", 1, gram))
    long = offers.join(asked.where(F.length("alternative") >= gram), ["project_id", "gram"])
    # Alternatives of one or two letters are the start of some gram.
    short = offers.withColumn("gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2), F.substring("gram", 2, 1), F.substring("gram", 2, 2), F.substring("gram", 3, 1)))).join(asked.where(F.length("alternative") < gram), ["project_id", "gram"])
    met = long.unionByName(short).where(F.contains("text", "alternative"))
    return met.select("proposal_id", "memory_id").distinct().withColumn("occurrences", F.lit(1).cast("long")).withColumn("applicability", F.lit("current"))
