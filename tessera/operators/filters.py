"""Gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import publisher_host
from tessera.operators.scoring import substantive_for_scoring


def list_candidates(candidates: DataFrame, statuses: list[str], cursor: tuple[float, int] | None = None, limit: int = 100) -> DataFrame:
    """A page of candidates by score, after the cursor (score, id)."""
    x = candidates.filter(F.col("status").isin(*statuses) & (F.col("status") != "archived"))
    if cursor:
        x = x.filter((F.col("score") < cursor[0]) | ((F.col("score") == cursor[0]) & (F.col("candidate_id") < cursor[1])))
    return x.orderBy(F.desc("score"), F.desc("candidate_id")).limit(limit)


def facet_match(values: Column, selected: list[str]) -> Column:
    """Whether any value is selected, whatever the case; an empty selection passes all."""
    if not selected:
        return F.lit(True)
    return F.arrays_overlap(F.transform(values, lambda v: F.lower(F.trim(v))), F.array(*[F.lit(s.strip().lower()) for s in selected]))


def all_terms(haystack: Column, asked: str) -> Column:
    low = F.lower(haystack)
    out = F.lit(True)
    for term in asked.lower().split():
        out = out & F.contains(low, F.lit(term))
    return out


def post_filters(candidates: DataFrame, evidence: DataFrame, min_score: float | None = None, statuses: list[str] = (), types: list[str] = (), sources: list[str] = ()) -> DataFrame:
    """OR within a filter, AND across filters; an empty one is none. Existence checks are semi-joins."""
    x = candidates if min_score is None else candidates.filter(F.col("score") >= min_score)
    if statuses:
        x = x.filter(facet_match(F.array("status"), list(statuses)))
    for column, wanted in (("type", types), ("source", sources)):
        if wanted:
            x = x.join(evidence.filter(F.col(column).isin(*wanted)).select("candidate_id"), "candidate_id", "left_semi")
    return x


def review_queue_gate(candidates: DataFrame, evidence: DataFrame, minimum: float) -> DataFrame:
    grounded = substantive_for_scoring(evidence).groupBy("candidate_id").agg(F.count("*").alias("facts"), F.count_distinct(publisher_host("source_url")).alias("publishers")).filter("facts >= 2 AND publishers >= 2")
    return candidates.filter(F.col("status").isin("new", "watching", "saved") & (F.col("score") >= minimum)).join(grounded, "candidate_id")


def referral_allowed() -> Column:
    """No referral of unresolved or unsure identities, nor where the stage reads like a minor's."""
    return (F.col("resolution") == "resolved") & (F.col("confidence") >= 0.72) & ~F.lower("stage").rlike("school|minor|teen")


def verified_facts(verdicts: DataFrame) -> DataFrame:
    """Supported facts of claims with a whole set of verdicts and no conflict; anything else fails closed."""
    sure = verdicts.groupBy("claim_id").agg(F.count("*").alias("n"), F.max("conflict").alias("bad")).filter("n >= 2 AND NOT bad").select("claim_id")
    return verdicts.filter("supported").join(sure, "claim_id", "left_semi")


def graph_seed_gate(candidates: DataFrame, evidence: DataFrame, n: int = 25) -> DataFrame:
    sources = evidence.groupBy("candidate_id").agg(F.count_distinct("source").alias("sources"))
    pool = candidates.filter((F.col("status") != "archived") & (F.col("score") >= 35) & (F.greatest("confidence", F.col("momentum") / 32) >= 0.3) & (F.col("resolution") == "resolved"))
    return pool.join(sources, "candidate_id").orderBy(F.desc("score"), F.desc("sources"), "candidate_id").limit(n)


def introduces() -> Column:
    return (F.col("confidence") >= 0.75) & (F.col("type") == "profile_observed") & F.lower("title").rlike("(^| )(of|founder|engineer)( |$)")
