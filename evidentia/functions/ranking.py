"""Ranking weights and the score of a memory record, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of trust states, half-lives in days, weights of the ranking.
TRUST_RANK = {"quarantined": 1, "observed": 2, "verified": 3, "reviewed": 4, "integrated": 5}
TERMINAL = ("invalidated", "superseded", "rejected")
HALF_LIFE = {"episodic": 14.0, "performance": 30.0, "semantic": 60.0, "gotcha": 90.0, "procedural": 180.0, "decision": 365.0}
WEIGHTS = {"lexical": 1.0, "trust": 0.5, "evidence": 0.3, "recency": 0.25, "usage": 0.15, "type": 0.2, "scope": 0.3, "contradiction": 0.4, "poison": 0.6}
TYPE_MISMATCH = 0.5
SATURATION = 50


def looked_up(column: str, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def trust_rank(column: str = "trust_state") -> Column:
    return looked_up(column, {k: float(v) for k, v in TRUST_RANK.items()}, 0.0).cast("int")


def recency(age_days: Column, half_life: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / half_life)


def usage(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(count.cast("double")) / F.log1p(F.lit(float(SATURATION))))


def evidence_weight() -> Column:
    """What ran, what was approved, what landed."""
    ran = F.when(F.col("verification_state") != "unknown", 0.4).otherwise(0.0)
    approved = F.when(F.col("review_state") == "approved", 0.3).otherwise(0.0)
    landed = F.when(F.col("integration_state").isin("integrated_run", "accepted_user"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), ran + approved + landed)


def type_match(wanted: tuple[str, ...]) -> Column:
    """A nudge towards the types asked for, no filter."""
    return F.when(F.col("memory_type").isin(*wanted), 1.0).otherwise(TYPE_MISMATCH) if wanted else F.lit(1.0)


def score_terms(lexical: Column, scope: Column, wanted: tuple[str, ...] = (), contested: Column | None = None) -> dict[str, Column]:
    """The weighted terms of a score; penalties are negative."""
    return {
        "lexical": WEIGHTS["lexical"] * lexical,
        "trust": WEIGHTS["trust"] * trust_rank() / 5,
        "evidence": WEIGHTS["evidence"] * evidence_weight(),
        "recency": WEIGHTS["recency"] * recency(F.col("age_days"), looked_up("memory_type", HALF_LIFE, 60.0)),
        "usage": WEIGHTS["usage"] * usage(F.col("access_count")),
        "type": WEIGHTS["type"] * type_match(wanted),
        "scope": WEIGHTS["scope"] * scope,
        "contradiction": -WEIGHTS["contradiction"] * (F.when(contested, 1.0).otherwise(0.0) if contested is not None else F.lit(0.0)),
        "poison": -WEIGHTS["poison"] * F.col("poisoning_risk"),
    }


def score(lexical: Column, scope: Column, wanted: tuple[str, ...] = (), contested: Column | None = None) -> Column:
    """The sum of all terms, to six digits."""
    return F.bround(sum(score_terms(lexical, scope, wanted, contested).values(), F.lit(0.0)), 6)


def reasons(lexical: Column, applicability: Column, why: Column, query_branch: str | None, contested: Column, resolved: Column, provenance: Column) -> Column:
    """Why a record was returned, as ordered sentences that name evidence."""
    times = F.when(F.col("access_count") == 1, "once").otherwise(F.concat(F.col("access_count").cast("string"), F.lit(" times")))
    here = F.coalesce(F.col("branch") == F.lit(query_branch), F.lit(False))
    label = F.when(applicability == "current", "current here").when(applicability == "historical", "historical").when(applicability == "cross", "from another scope").otherwise("applicability uncertain")
    return F.array_compact(
        F.array(
            F.when(lexical > 0, F.format_string("matched the query text (relevance %.2f)", lexical)),
            F.concat(F.lit("same project ("), F.col("project_id"), F.lit(")")),
            F.when(here, F.concat(F.lit("recorded on this branch ("), F.lit(query_branch), F.lit(")"))).when(F.col("scope_level").isin("repository", "project"), F.concat(F.lit("applies at "), F.col("scope_level"), F.lit(" scope"))),
            F.concat(label, F.lit(" \u2014 "), why),
            F.when(provenance != "", provenance),
            F.when(F.col("access_count") > 0, F.concat(F.lit("retrieved "), times, F.lit(" before"))),
            F.when(resolved, F.lit("linked to what later worked")),
            F.when(contested, F.lit("contested by another current record on the same subject")),
            F.when(F.col("poisoning_risk") > 0, F.format_string("carries a poisoning-risk penalty of %.2f", F.col("poisoning_risk"))),
        )
    )


def warnings(truth: Column, applicability: Column, contested: Column, complete: Column, n_matches: Column) -> Column:
    """What a reader must not conclude, as ordered sentences."""
    state = F.col("trust_state")
    standing = (
        F.when(F.col("memory_type") == "semantic", F.lit("NOT established project truth: this semantic record has not landed in history, so it reflects one branch or one attempt"))
        .when(state.isin(*TERMINAL), F.concat(F.lit("withdrawn ("), state, F.lit("); retained as history, not as fact")))
        .otherwise(F.concat(F.lit("not established truth (trust state "), state, F.lit(")")))
    )
    place = F.when(applicability == "uncertain", "applicability at the queried commit could not be determined").when(applicability == "historical", "introduced on a different line of history").when(applicability == "cross", "recorded in a different scope than the query")
    return F.array_compact(
        F.array(
            F.when(~truth, standing),
            place,
            F.when(contested, F.lit("contradicted by another current record; neither is auto-resolved")),
            F.when(~complete, F.lit("provenance could not be fully resolved")),
            F.when(F.col("poisoning_risk") > 0, F.concat(F.lit("matched "), n_matches.cast("string"), F.lit(" poisoning heuristic(s); treat the content with extra suspicion"))),
            F.when(state == "quarantined", F.lit("QUARANTINED: untrusted content, shown only because requested")),
        )
    )
